"""Queries: contexts, prompts, answers, follow-up questions, embeddings, and text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_repair, text, unicode
from ..operators import context, embeddings, graph, logs, resolve, validation
from ..operators import retrieval as R
from ..sources.corpus import Corpus, sql
from .papers import _KEYS, _VALID, TITLE_SQL, YEAR, _shared
from .registry import query

_KIND = {"en": "knowledge_package", "de": "research_gap_report", "es": "research_landscape", "fr": "paper_collection"}
_TOTAL = 9_000
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ARTIFACTS = f"""a AS (SELECT doc_id AS id, source AS investigation_id, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KIND.items())} ELSE 'validated_collection' END AS artifact_type, text AS payload FROM documents WHERE doc_id % 7 <> 0 AND text <> ''),
  n AS (SELECT *, list_position({list(context.BUDGETS)}, artifact_type) AS position, {list(context.BUDGETS.values())}[list_position({list(context.BUDGETS)}, artifact_type)] AS share FROM a QUALIFY row_number() OVER (PARTITION BY investigation_id, artifact_type ORDER BY id DESC) = 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY position) AS k FROM n),
  f AS (SELECT investigation_id, 0::BIGINT AS k, {_TOTAL}::BIGINT AS free, 0::BIGINT AS position, '' AS artifact_type, NULL::VARCHAR AS content FROM (SELECT DISTINCT investigation_id FROM o)
    UNION ALL SELECT investigation_id, k, CASE WHEN free > 0 THEN free - length(c) ELSE free END, position, artifact_type, CASE WHEN free > 0 THEN c END FROM (SELECT *, CASE WHEN length(payload) <= cap THEN payload WHEN contains(left(payload, cap), chr(10)) THEN left(payload, cap - instr(reverse(left(payload, cap)), chr(10))) ELSE left(payload, cap) END AS c
      FROM (SELECT o.investigation_id, o.k, f.free, o.position, o.artifact_type, o.payload, least(o.share, greatest(f.free, 0))::BIGINT AS cap FROM f JOIN o ON o.investigation_id = f.investigation_id AND o.k = f.k + 1)))"""


def _contexts(c: Corpus) -> DataFrame:
    d = c.table("documents")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in _KIND.items() for x in pair])[F.col("lang")], F.lit("validated_collection"))
    a = d.select(F.col("doc_id").alias("id"), F.col("source").alias("investigation_id"), kind.alias("artifact_type"), F.when(F.col("doc_id") % 7 == 0, "draft").otherwise("ready").alias("status"), F.col("doc_id").alias("created_at"), F.col("text").alias("payload"))
    return context.artifact_context(a, total=_TOTAL)


@query(f"WITH RECURSIVE {_ARTIFACTS} SELECT investigation_id, position::INT AS position, artifact_type, md5(content) AS content FROM f WHERE content IS NOT NULL")
def artifact_context(c: Corpus) -> DataFrame:
    return _contexts(c).withColumn("content", F.md5(F.col("content").cast("binary")))


_LABEL = "array_to_string(list_transform(string_split(artifact_type, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"


@query(f"""WITH RECURSIVE {_ARTIFACTS} SELECT investigation_id, md5(string_agg('=== ' || {_LABEL} || ' ===' || chr(10) || content, chr(10) || chr(10) ORDER BY position) || CASE WHEN sum(length(content)) >= {_TOTAL} THEN chr(10) || '{context.CUT_NOTE}' ELSE '' END) AS context FROM f WHERE content IS NOT NULL GROUP BY 1""")
def context_texts(c: Corpus) -> DataFrame:
    return context.context_text(_contexts(c), total=_TOTAL).withColumn("context", F.md5(F.col("context").cast("binary")))


@query(sql("raw_papers", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS k FROM raw_papers)
  SELECT source, md5(string_agg('Title: ' || title || chr(10) || 'Authors: ' || array_to_string(authors, ', ') || chr(10) || 'Abstract: ' || coalesce(left(abstract, 400), '') || chr(10) || 'DOI: ' || coalesce(nullif(doi, ''), 'N/A'), chr(10) || chr(10) ORDER BY k)) AS context FROM k WHERE k <= 15 GROUP BY 1"""))
def paper_contexts(c: Corpus) -> DataFrame:
    return context.paper_context(c.raw_papers(), "source").withColumn("context", F.md5(F.col("context").cast("binary")))


def _sections(c: Corpus) -> DataFrame:
    """Documents as sections of a question for each source: labels by language, scores by length."""
    label = F.coalesce(F.create_map(*[F.lit(x) for x in ("en", "Key Findings", "de", "Datasets", "es", "Limitations", "fr", "Future Work")])[F.col("lang")], F.lit("Other"))
    return c.table("documents").where("text is not null").select(F.col("source").alias("question_id"), F.lit("Knowledge Package").alias("source"), label.alias("label"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), F.col("n_chars").cast("double").alias("score"))


_SECTIONS = "s AS (SELECT source AS question_id, CASE lang WHEN 'en' THEN 'Key Findings' WHEN 'de' THEN 'Datasets' WHEN 'es' THEN 'Limitations' WHEN 'fr' THEN 'Future Work' ELSE 'Other' END AS label, doc_id AS pos, text AS content, n_chars AS score FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_SECTIONS}, t AS (SELECT question_id, string_agg('[Knowledge Package / ' || label || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY score DESC, pos) AS c FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) <= 15) GROUP BY 1)
  SELECT question_id, md5('{context.INSTRUCTIONS.replace("'", "''")}' || chr(10) || chr(10) || '## Context' || chr(10) || chr(10) || c || chr(10) || chr(10) || '## Question' || chr(10) || chr(10) || 'What of ' || question_id || '?') AS system, 'Question: What of ' || question_id || '?' AS user FROM t""")
def build_prompts(c: Corpus) -> DataFrame:
    q = c.table("documents").select(F.col("source").alias("question_id")).distinct().select("question_id", F.concat(F.lit("What of "), "question_id", F.lit("?")).alias("text"), F.lit("evidence_lookup").alias("intent"))
    return context.prompts(q, _sections(c)).withColumn("system", F.md5(F.col("system").cast("binary")))


_BARE = f"regexp_replace(regexp_replace({_STRIP.format('x')}, '^\\[.*?\\]\\s*', ''), '^[-•*]\\s*', '')"
_HEAD = _STRIP.format("left(CASE WHEN instr(x, ':') > 1 THEN split_part(x, ':', 1) ELSE x END, 80)")
_ASKED = ", ".join(f"({k}, '{q}', '{label}')" for k, (q, _, label) in enumerate(context.ALWAYS) if label)


@query(f"""WITH {_SECTIONS}, t AS (SELECT *, list_filter(list_transform(list_transform(string_split(content, chr(10)), lambda x: {_BARE}), lambda x: {_HEAD}), lambda x: length(x) > 5)[1:2] AS topics FROM s),
  l AS (SELECT question_id, 0 AS phase, pos AS place, q || CASE WHEN len(topics) > 0 THEN ' are most relevant to ' || array_to_string(topics, ', ') || '?' ELSE ' are used in this research area?' END AS text FROM t
    JOIN (VALUES ('Key Findings', 'What are the key findings'), ('Datasets', 'What datasets'), ('Limitations', 'What limitations'), ('Future Work', 'What future work directions')) AS v(label, q) USING (label)),
  e AS (SELECT DISTINCT question_id, 1 AS phase, k AS place, q || ' in these studies?' AS text FROM s JOIN (VALUES {', '.join(f"({k}, '{w}', '{q}')" for k, (w, q) in enumerate(context.EVIDENCE_QUESTIONS))}) AS v(k, w, q) ON contains(lower(content), w)),
  g AS (SELECT DISTINCT question_id, 2 AS phase, k AS place, q AS text FROM s JOIN (VALUES {_ASKED}) AS v(k, q, label) ON lower(s.label) = v.label),
  p AS (SELECT DISTINCT question_id, 2 AS phase, k AS place, q AS text FROM s, (VALUES {', '.join(f"({k}, '{q}')" for k, (q, *_) in enumerate(context.ALWAYS[:3]))}) AS v(k, q) WHERE question_id NOT IN (SELECT question_id FROM g)),
  u AS (SELECT * FROM l UNION ALL SELECT * FROM e UNION ALL SELECT * FROM g UNION ALL SELECT * FROM p), d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') ORDER BY phase, place, text) = 1)
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY phase, place, text) AS position, text FROM d QUALIFY position <= 5""")
def suggest_questions(c: Corpus) -> DataFrame:
    s = _sections(c)
    return context.follow_ups(s, s, s.select("question_id", F.col("content").alias("claim")))


@query(f"""WITH {_SECTIONS}, sem AS (SELECT question_id, pos FROM s WHERE score > 4000), r AS (SELECT question_id, pos, 'semantic' AS retriever FROM sem UNION ALL SELECT question_id, pos, 'heuristic' FROM s WHERE question_id NOT IN (SELECT question_id FROM sem) AND label = 'Datasets') SELECT * FROM r""")
def retrieve_with_fallback(c: Corpus) -> DataFrame:
    s = _sections(c)
    return context.with_fallback(s.where("score > 4000").select("question_id", "pos"), s.where("label = 'Datasets'").select("question_id", "pos"), ["question_id"])


@query("""WITH raw AS (SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events) SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'plain ' || k ELSE 'a' || k END AS answer, CASE event_id % 3 WHEN 0 THEN least(k / 10.0, 1.0)::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS questions FROM raw""")
def parse_answers(c: Corpus) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    full = F.concat(F.lit('Sure:\n```json\n{"answer": "a'), k, F.lit('", "confidence": '), (k.cast("long") / 10).cast("string"), F.lit(', "suggested_questions": ["q"]}\n```'))
    raw = F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"answer": "a'), k, F.lit('"}'))).otherwise(F.concat(F.lit("plain "), k))
    a = context.answers(c.table("events").select("event_id", raw.alias("raw")), "raw")
    return a.select("event_id", "answer", "confidence", F.size("suggested_questions").alias("questions"))


@query("""WITH i AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, event_id % 5 AS v FROM events WHERE event_type = 'view') SELECT i.user_id AS investigation_id, count(v) AS chunks, coalesce(max(v), 0) AS max_version FROM i LEFT JOIN s USING (user_id) GROUP BY 1""")
def embedded_counts(c: Corpus) -> DataFrame:
    e = c.table("events").select(F.col("user_id").alias("investigation_id"), "event_type", (F.col("event_id") % 5).alias("artifact_version"))
    return embeddings.embedded_counts(e, e.where("event_type = 'view'"))


@query("""WITH s AS (SELECT user_id, max(event_id % 5) AS m FROM events WHERE event_type = 'view' GROUP BY 1) SELECT event_id AS id, coalesce(m, 0) + 1 AS next_version FROM events LEFT JOIN s USING (user_id) WHERE event_type = 'click' AND (event_id % 7 = 0 OR event_id % 7 > coalesce(m, 0))""")
def embeddings_to_refresh(c: Corpus) -> DataFrame:
    e = c.table("events").select("event_id", F.col("user_id").alias("investigation_id"), "event_type")
    stored = e.where("event_type = 'view'").select("investigation_id", (F.col("event_id") % 5).alias("artifact_version"))
    ready = e.select(F.col("event_id").alias("id"), "investigation_id", (F.col("event_id") % 7).alias("version"), F.when(F.col("event_type") == "click", "ready").otherwise("draft").alias("status"))
    return embeddings.to_refresh(ready, stored).select("id", "next_version")


_REQUESTS = "r AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, event_type AS endpoint, CASE WHEN event_id % 11 = 0 THEN 500 WHEN event_id % 5 = 0 THEN 404 ELSE 200 END AS status, value AS seconds FROM events)"


def _log(c: Corpus) -> DataFrame:
    k = F.col("event_id")
    return c.table("events").select(F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"), F.col("event_type").alias("endpoint"), F.when(k % 11 == 0, 500).when(k % 5 == 0, 404).otherwise(200).alias("status"), F.col("value").alias("seconds"))


@query(f"WITH {_REQUESTS} SELECT method, endpoint, status, count(*) AS requests, (status // 100) || 'xx' AS status_class FROM r GROUP BY ALL")
def request_counts(c: Corpus) -> DataFrame:
    return logs.request_metrics(_log(c), [])[0]


@query(f"WITH {_REQUESTS} SELECT method, endpoint, count(*) AS count, round(sum(seconds), 4) AS sum, count_if(seconds <= 10)::BIGINT AS le_10, count_if(seconds <= 100)::BIGINT AS le_100 FROM r GROUP BY ALL")
def request_durations(c: Corpus) -> DataFrame:
    return logs.request_metrics(_log(c), [10, 100])[1]


@query(sql("papers technologies", """WITH y AS (SELECT investigation_id, name, year, count(DISTINCT paper_id) AS n FROM technologies JOIN papers USING (paper_id) GROUP BY ALL),
  s AS (SELECT *, lag(n) OVER (PARTITION BY investigation_id, name ORDER BY year) AS b, row_number() OVER (PARTITION BY investigation_id, name ORDER BY year DESC) AS k, max(year) OVER () AS latest FROM y),
  g AS (SELECT investigation_id, name, coalesce((n - b) / b, 0) AS growth FROM s WHERE k = 1 AND year >= latest - 2) SELECT investigation_id, name, round(growth, 4) AS growth, row_number() OVER (PARTITION BY investigation_id ORDER BY growth DESC, name) AS rank FROM g WHERE growth > 0 QUALIFY rank <= 10"""))
def top_emerging(c: Corpus) -> DataFrame:
    by = ["investigation_id", "name"]
    papers = c.papers().select("paper_id", "investigation_id", "year")
    t = graph.trends(graph.yearly(c.technologies().join(papers.select("paper_id", "investigation_id"), "paper_id"), papers, by), by)
    return graph.top_emerging(t, 10, ["investigation_id"]).select("investigation_id", "name", F.round("growth", 4).alias("growth"), "rank")


@query(sql("raw_papers", f"{_VALID} SELECT count(*) AS total, count_if(status = 'valid')::BIGINT AS valid, count_if(status = 'warning')::BIGINT AS warning, count_if(status = 'invalid')::BIGINT AS invalid, count_if(issues LIKE '%duplicate_url%')::BIGINT AS duplicates, coalesce(round(avg(score), 1), 0) AS average_score FROM s"))
def validation_stage_summary(c: Corpus) -> DataFrame:
    v = validation.scored(validation.with_issues(c.raw_papers(), YEAR))
    said = F.transform("issues", lambda i: F.when(i.isin("duplicate_doi", "duplicate_title"), F.concat(F.lit("D"), F.substring(i, 2, 100))).otherwise(i))
    return validation.stage_summary(v.withColumn("messages", said))


@query("""WITH n AS (SELECT p_partkey AS id, unnest([p_name, p_type, p_brand, 'TBD', '12']) AS name FROM part), s AS (SELECT *, round(least(0.5 + CASE WHEN length(name) >= 10 THEN 0.2 WHEN length(name) >= 5 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(substr(name, 2), '[A-Z]') THEN 0.1 ELSE 0 END, 1.0), 2)::DOUBLE AS confidence FROM n WHERE name NOT IN ('TBD', '12'))
  SELECT id, name, confidence FROM s WHERE confidence >= 0.7""")
def valid_entities(c: Corpus) -> DataFrame:
    p = c.table("part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type", "p_brand", F.lit("TBD"), F.lit("12")).alias("names"))
    return p.select("id", F.explode(text.valid_entities(F.col("names"), "dataset", 0.7)).alias("e")).select("id", "e.name", "e.confidence")


@query(sql("raw_papers", f"""WITH RECURSIVE k AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i, list_filter(['doi:' || {_KEYS['doi']}, 'title:' || {_KEYS['title']}, 'norm:' || nullif({TITLE_SQL.format('title')}, '')], lambda x: x IS NOT NULL) AS keys FROM raw_papers),
  walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS pos, false AS kept, []::VARCHAR[] AS owned UNION ALL SELECT k.i, k.pos, NOT list_has_any(walk.owned, k.keys), CASE WHEN list_has_any(walk.owned, k.keys) THEN walk.owned ELSE list_concat(walk.owned, k.keys) END FROM walk JOIN k ON k.i = walk.i + 1)
  SELECT pos FROM walk WHERE kept"""))
def deduplicate_papers(c: Corpus) -> DataFrame:
    _shared(c)
    return resolve.kept_first(c.raw_papers(), ("doi", "title", "norm")).select("pos")


@query(sql("papers methodologies", """WITH k AS (SELECT paper_id, name FROM methodologies UNION ALL SELECT -paper_id, name FROM methodologies) SELECT k.paper_id, k.name, year, coalesce(citations, 0) AS citations, venue FROM k LEFT JOIN papers p ON p.paper_id = k.paper_id"""))
def knowledge_with_meta(c: Corpus) -> DataFrame:
    m = c.methodologies()
    return graph.with_paper_meta(m.unionByName(m.select((-F.col("paper_id")).alias("paper_id"), "name")), c.papers()).select("paper_id", "name", "year", "citations", "venue")


@query("SELECT l_orderkey AS paper_id, 'author' AS type, s_name AS name, count(*) AS occurrences FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 3")
def mention_multiset(c: Corpus) -> DataFrame:
    s = c.table("supplier").select("s_suppkey", F.col("s_name").alias("name"))
    mentions = c.table("lineitem").select(F.col("l_orderkey").alias("paper_id"), "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("paper_id", F.lit("author").alias("type"), "name")
    return graph.occurrences(mentions)


@query("SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def fn_accents(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", F.md5(unicode.strip_accents(F.col("text")).cast("binary")).alias("bare"))


@query("SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> ''), ' ')) AS abstract FROM documents WHERE regexp_matches(text, '[^ \t\n]')")
def fn_abstract_index(c: Corpus) -> DataFrame:
    index = text.inverted_index(c.table("documents"), "doc_id", "text")
    return index.select("doc_id", F.md5(text.abstract_from_index(F.col("index")).cast("binary")).alias("abstract"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '10.5/' || page_id END AS doi, CASE WHEN page_id % 3 = 0 THEN 'arxiv:' || page_id || '|' ELSE '' END || 'openalex:w' || page_id AS ids FROM pages")
def fn_identifiers(c: Corpus) -> DataFrame:
    k = F.col("page_id").cast("string")
    doi = text.doi_from_url(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://doi.org/10.5/"), k)).otherwise(F.col("url")))
    ids = text.external_ids(arxiv=F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), k)), openalex=F.concat(F.lit("W"), k))
    return c.table("pages").select("page_id", doi.alias("doi"), F.array_join(F.transform(ids, lambda e: F.concat(e["namespace"], F.lit(":"), e["id"])), "|").alias("ids"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN replace(props, ' ', '') END AS json FROM events")
def fn_json_repair(c: Corpus) -> DataFrame:
    k, p = F.col("event_id") % 4, F.col("props")
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), p, F.lit(" as asked"))).when(k == 2, p).otherwise(F.lit("no json here"))
    return c.table("events").select("event_id", json_repair.repair_json(raw).alias("json"))


@query("SELECT p_partkey AS id FROM part WHERE length(p_name) < 20 OR (p_size % 2 = 0 AND p_size % 3 = 0)")
def low_quality_records(c: Corpus) -> DataFrame:
    from ..operators.sections import low_quality

    s = F.col("p_size")
    empty = F.array().cast("array<string>")
    p = c.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("summary"), F.when(s % 2 == 0, empty).otherwise(F.array("p_type")).alias("research_questions"), F.when(s % 3 == 0, empty).otherwise(F.array("p_type")).alias("key_findings"), F.lit("").alias("methodology"))
    return p.where(low_quality()).select("id")


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS id FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def newest_artifact_of_type(c: Corpus) -> DataFrame:
    from ..operators.sinks import latest_ready

    e = c.table("events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("click", "view"), "ready").otherwise("draft").alias("status"), F.col("props").alias("payload"))
    return latest_ready(e, ["event_type"]).select("event_type", "id")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND text ILIKE '%the%'")
def notes_of_source(c: Corpus) -> DataFrame:
    n = c.table("conversations").select("conv_id", "turn", F.lit("").alias("title"), F.col("text").alias("content"), F.col("role").alias("source_type"))
    return logs.searched_notes(n, "the", "assistant").select("conv_id", "turn")


@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, len(list_filter(t, lambda x: length(x) > 8)) AS n FROM d) SELECT doc_id, n FROM q WHERE n > 0""")
def long_tokens(c: Corpus) -> DataFrame:
    d = c.table("documents").where("text is not null")
    return d.select("doc_id", F.size(F.filter(text.tokens(F.col("text")), lambda x: F.length(x) > 8)).cast("long").alias("n")).where("n > 0")


@query()
def embedded_after_refresh(c: Corpus) -> DataFrame:
    """All artifacts of documents embedded anew at the next version over a store that has the first chunk of each. No SQL: vectors."""
    d = c.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("investigation_id"), F.lit(2).alias("version"), F.lit("ready").alias("status"), F.col("text").alias("payload"))
    stored = R.embed(d.select("investigation_id", F.col("id").alias("artifact_id"), F.lit(0).alias("chunk_index"), F.substring("payload", 1, 800).alias("content"), F.lit(1).cast("long").alias("artifact_version")), "content", 64)
    return embeddings.refreshed(d, stored, dimensions=64).select("investigation_id", "artifact_id", "chunk_index", "artifact_version", F.size("embedding").alias("dimensions"))
