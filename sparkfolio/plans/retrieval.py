"""Queries: chunks, search, evidence, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_overlap
from ..functions.words import (
    COMPARE_WORDS, COMPARISON, DATASET_WORDS, EVIDENCE_PHRASES, FUTURE_PHRASES, GAP_WORDS, HEDGES, HOW_WHY, LIMITATION_PHRASES, METHOD_WORDS, PAPER_WORDS, SIGNALS, STOP_WORDS, SUMMARY_PHRASES,
    TECHNOLOGY_WORDS, TREND_PHRASES,
)
from ..operators import retrieval as R
from ..operators.budget import within_budget_split
from ..sources.corpus import Corpus
from .registry import query


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("""WITH RECURSIVE c AS (
    SELECT doc_id, 0 AS chunk_index, text, 0 AS s FROM documents WHERE trim(text) <> ''
    UNION ALL SELECT doc_id, chunk_index + 1, text, e - 80 FROM (SELECT *, CASE WHEN s + 800 >= length(text) THEN length(text) WHEN position(chr(10) IN reverse(substr(text, s + 401, 400))) > 0 THEN s + 800 - position(chr(10) IN reverse(substr(text, s + 401, 400))) ELSE s + 800 END AS e FROM c) WHERE e < length(text))
  SELECT doc_id, chunk_index::INT AS chunk_index, md5(substr(text, s + 1, CASE WHEN s + 800 >= length(text) THEN length(text) WHEN position(chr(10) IN reverse(substr(text, s + 401, 400))) > 0 THEN s + 800 - position(chr(10) IN reverse(substr(text, s + 401, 400))) ELSE s + 800 END - s)) AS digest FROM c""")
def chunk_documents(c: Corpus) -> DataFrame:
    return R.chunked(c.table("documents"), "doc_id", "text").select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  s AS (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q) AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 20) SELECT vec_id, round(s, 4) AS score FROM s WHERE s >= 0.1""")
def vector_search(c: Corpus) -> DataFrame:
    e = c.table("embeddings").select("vec_id", "embedding")
    q = e.orderBy("vec_id").first()["embedding"]  # the question's vector
    return R.nearest(e, q, 20, 0.1).select("vec_id", F.round("score", 4).alias("score"))


QUESTION = {"keywords": ["the", "que"], "bigrams": ["of the"], "phrases": ["thonan"], "signals_methodology": ["er"], "signals_gap": ["x"]}


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(lang, '')) AS name FROM documents)
  SELECT doc_id, (10.0 * len(regexp_extract_all(t, '\\bthe\\b')) + 10.0 * len(regexp_extract_all(t, '\\bque\\b')) + 15.0 * ((length(t) - length(replace(t, 'of the', ''))) // 6)
    + 100.0 * contains(t, 'thonan')::INT + 30.0 * (name IN ('the', 'que', 'of the'))::INT + 12.0 * contains(t, 'er')::INT + 20.0)::DOUBLE AS score FROM d""")
def keyword_scores(c: Corpus) -> DataFrame:
    d = c.table("documents")
    return d.select("doc_id", R.keyword_score(QUESTION, F.col("text"), F.col("lang")).alias("score"))


_ASKED = "the data of a new model and la que"
_SCORED = f"""d AS (SELECT doc_id, source, lang, coalesce(n_chars, 0) AS chars, lower(coalesce(text, '')) AS t, lower(coalesce(lang, '')) AS name FROM documents),
  k AS (SELECT *, (10.0 * len(regexp_extract_all(t, '\\bthe\\b')) + 10.0 * len(regexp_extract_all(t, '\\bque\\b')) + 15.0 * ((length(t) - length(replace(t, 'of the', ''))) // 6)
    + 100.0 * contains(t, 'thonan')::INT + 30.0 * (name IN ('the', 'que', 'of the'))::INT + 12.0 * contains(t, 'er')::INT + 20.0)::DOUBLE AS kw, list_distinct(list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '')) AS w FROM d),
  sc AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_intersect(w, {_ASKED.split()})) / least(len(w), {len(set(_ASKED.split()))}) ELSE 0 END AS sem FROM k)"""


@query(f"""WITH {_SCORED}, h AS (SELECT doc_id, lang, 0.7 * sem + 0.3 * least(kw / 100, 1.0) AS h FROM sc)
  SELECT doc_id, round(CASE WHEN lang = 'de' THEN least(h + 0.25, 1.0) ELSE h END, 4)::DOUBLE AS score FROM h""")
def hybrid_scores(c: Corpus) -> DataFrame:
    """Overlap with a question's words as the semantic part, keyword points, and a boost for German documents as methodologies."""
    d = c.table("documents")
    semantic = content_overlap(F.coalesce("text", F.lit("")), F.lit(_ASKED))
    label = F.when(F.col("lang") == "de", "Methodologies").otherwise("Datasets")
    s = d.select("doc_id", R.hybrid(semantic, R.keyword_score(QUESTION, F.col("text"), F.col("lang"))).alias("score"), label.alias("label"), F.lit("any").alias("source"))
    return R.boosted(s, "methodology_comparison").select("doc_id", F.round("score", 4).alias("score"))


@query("""WITH RECURSIVE s AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
  w AS (SELECT source, k, doc_id, n_chars <= 8000 AS kept, 8000 - CASE WHEN n_chars <= 8000 THEN n_chars ELSE 0 END AS free FROM s WHERE k = 1
    UNION ALL SELECT s.source, s.k, s.doc_id, s.n_chars <= w.free, w.free - CASE WHEN s.n_chars <= w.free THEN s.n_chars ELSE 0 END FROM w JOIN s ON s.source = w.source AND s.k = w.k + 1)
  SELECT source, doc_id FROM w WHERE kept""")
def context_budget(c: Corpus) -> DataFrame:
    s = c.table("documents").select("source", "doc_id", F.col("n_chars").alias("char_count"))
    return within_budget_split(s, ["source"], 8000, [F.col("doc_id")]).select("source", "doc_id")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents), s AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS x FROM l),
  k AS (SELECT doc_id, line::INT AS line, regexp_replace(regexp_replace(x, '^\\[.*?\\]\\s*', ''), '^[-•*]\\s*', '') AS claim FROM s WHERE length(x) >= 15)
  SELECT doc_id, line, md5(claim) AS claim, {' OR '.join(f"contains(lower(claim), '{h}')" for h in HEDGES)} AS is_inference FROM k WHERE length(claim) >= 15""")
def evidence_claims(c: Corpus) -> DataFrame:
    d = c.table("documents").select("doc_id", F.col("text").alias("content"))
    return R.claims(d).select("doc_id", "line", F.md5(F.col("claim").cast("binary")).alias("claim"), "is_inference")


def _sections(c: Corpus) -> DataFrame:
    d = c.table("benchmark")
    k = F.col("item_id")
    return d.select((k % 4).alias("query_id"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source"), (k % 2).cast("string").alias("label"), k.alias("pos"), F.col("text").alias("content"), (k % 13 * 7.0).alias("score"))


_SECTIONS = "s AS (SELECT item_id % 4 AS query_id, 's' || (item_id % 3) AS source, (item_id % 2)::VARCHAR AS label, item_id AS pos, text AS content, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM benchmark)"


@query(f"WITH {_SECTIONS} SELECT a.query_id, a.pos AS a, b.pos AS b, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 4) AS overlap FROM s a JOIN s b ON a.query_id = b.query_id AND a.label = b.label AND a.pos < b.pos WHERE len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) > 0.25")
def section_overlaps(c: Corpus) -> DataFrame:
    return R.near_pairs(_sections(c), ["query_id"], 0.25).withColumn("overlap", F.round("overlap", 4))


_OVER = "len(list_intersect({0}, {1})) / least(len({0}), len({1}))"


@query(f"""WITH RECURSIVE {_SECTIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY item_score DESC, pos) AS k FROM (SELECT *, (pos % 13 * 7.0)::DOUBLE AS item_score FROM s)),
  w AS (SELECT query_id, label, pos, k, t, true AS kept, [t] AS held FROM o WHERE k = 1
    UNION ALL SELECT query_id, label, pos, k, t, NOT near, CASE WHEN near THEN held ELSE list_append(held, t) END FROM (SELECT o.query_id, o.label, o.pos, o.k, o.t, w.held, len(list_filter(w.held, lambda h: {_OVER.format('o.t', 'h')} > 0.3)) > 0 AS near FROM w JOIN o ON o.query_id = w.query_id AND o.label = w.label AND o.k = w.k + 1))
  SELECT query_id, pos FROM w WHERE kept""")
def compress_context(c: Corpus) -> DataFrame:
    return R.compressed(_sections(c), ["query_id"], 0.3).select("query_id", "pos")


@query()
def compress_chunks(c: Corpus) -> DataFrame:
    """Chunks of all documents, labelled by their source, as sections of one question."""
    doc_id, chunk = F.shiftright("pos", 22), F.col("pos").bitwiseAND((1 << 22) - 1)
    sections = _document_chunks(c).select(F.lit(0).alias("query_id"), F.col("source").alias("label"), "pos", "content", (doc_id % 13 * 7.0).alias("score"))
    return R.compressed(sections, ["query_id"]).select("label", doc_id.alias("doc_id"), chunk.alias("chunk_index"))


_CLAIMS = f"""l AS (SELECT query_id, pos, (i - 1)::INT AS line, (pos % 13 * 7.0)::DOUBLE AS score, {_STRIP.format("string_split(content, chr(10))[i]")} AS l FROM (SELECT *, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM s)),
  a AS (SELECT *, regexp_replace(regexp_replace(l, '^\\[.*?\\]\\s*', ''), '^[-•*]\\s*', '') AS claim FROM l WHERE length(l) >= 15), n AS (SELECT *, regexp_replace({_STRIP.format('lower(claim)')}, '[^a-z0-9\\s]', '', 'g') AS n FROM a WHERE length(claim) >= 15),
  o AS (SELECT *, list_distinct(list_filter(string_split_regex(n, '\\s+'), lambda x: x <> '')) AS t, row_number() OVER (PARTITION BY query_id ORDER BY pos, line) AS k FROM n WHERE length(n) >= 15)"""


@query(f"""WITH RECURSIVE {_SECTIONS}, {_CLAIMS},
  w AS (SELECT query_id, pos, line, k, true AS kept, [t] AS held FROM o WHERE k = 1
    UNION ALL SELECT query_id, pos, line, k, NOT near, CASE WHEN near THEN held ELSE list_append(held, t) END FROM (SELECT o.query_id, o.pos, o.line, o.k, o.t, w.held, len(list_filter(w.held, lambda h: {_OVER.format('o.t', 'h')} > 0.55)) > 0 AS near FROM w JOIN o ON o.query_id = w.query_id AND o.k = w.k + 1))
  SELECT o.query_id, o.pos, o.line, claim, least(score / 100, 1.0)::DOUBLE AS confidence, len(list_filter({HEDGES}, lambda h: contains(lower(claim), h))) > 0 AS is_inference FROM o JOIN w ON w.query_id = o.query_id AND w.k = o.k WHERE kept""")
def aggregate_evidence(c: Corpus) -> DataFrame:
    return R.aggregated_evidence(_sections(c), ["query_id"])


@query()
def aggregate_claims(c: Corpus) -> DataFrame:
    """Claims of all documents, the sections of their sources' questions."""
    d = c.table("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), (F.col("doc_id") % 13 * 7.0).alias("score"))
    return R.aggregated_evidence(d, ["query_id"]).select("query_id", "pos", "line", F.md5("claim").alias("claim_md5"), "confidence", "is_inference")


_QUESTIONS = f"q AS (SELECT conv_id, turn, text, {_STRIP.format('lower(text)')} AS raw FROM conversations WHERE role = 'user'), t AS (SELECT *, regexp_extract_all(raw, '[a-zA-Z][a-zA-Z0-9_\\-.#]*') AS tokens FROM q)"
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_ANY = "len(list_filter({0}, lambda w: contains({1}, w))) > 0"


@query(f"""WITH {_QUESTIONS}, k AS (SELECT *, list_filter(tokens, lambda x: length(x) > 1 AND NOT list_contains({STOP_WORDS}, x)) AS k0, list_filter(list_transform(range(1, greatest(len(tokens), 1)), lambda i: CASE WHEN NOT (list_contains({STOP_WORDS}, tokens[i]) AND list_contains({STOP_WORDS}, tokens[i + 1])) THEN tokens[i] || ' ' || tokens[i + 1] END), lambda x: x IS NOT NULL AND length(x) > 3) AS b0,
    list_filter(list_transform(regexp_extract_all(raw, '"([^"]+)"', 1), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 2) AS phrases FROM t),
  d AS (SELECT *, {_FIRST.format('k0')} AS keywords, {_FIRST.format('b0')} AS bigrams FROM k), a AS (SELECT *, list_distinct(list_concat(list_concat(keywords, bigrams), phrases)) AS terms FROM d)
  SELECT conv_id, turn, array_to_string(keywords, '|') AS keywords, array_to_string(bigrams, '|') AS bigrams, array_to_string(phrases, '|') AS phrases,
    {', '.join(f"array_to_string(list_sort(list_filter(terms, lambda x: {_ANY.format(SIGNALS[s], 'x')})), '|') AS signals_{s}" for s in ('methodology', 'gap'))}, list_has_any(tokens, {COMPARISON}) AS is_comparison, list_has_any(tokens, {HOW_WHY}) AS is_how_why FROM a""")
def analyze_questions(c: Corpus) -> DataFrame:
    q = R.analyzed(c.table("conversations").where("role = 'user'").select("conv_id", "turn", "text"))
    return q.select("conv_id", "turn", *[F.array_join(x, "|").alias(x) for x in ("keywords", "bigrams", "phrases", "signals_methodology", "signals_gap")], "is_comparison", "is_how_why")


def _about(words: list[str]) -> str:
    return f"(implicit <> '' AND (list_contains({words}, implicit) OR {_ANY.format([w for w in words if len(w) > 4], 'implicit')}))"


_INTENT = f"""CASE WHEN comparing AND (mentioned OR (targets >= 2 AND list_has_any(tokens, {PAPER_WORDS}))) THEN 'paper_comparison' WHEN comparing AND list_has_any(tokens, {TECHNOLOGY_WORDS}) THEN 'technology_comparison'
  WHEN comparing AND list_has_any(tokens, {METHOD_WORDS}) THEN 'methodology_comparison' WHEN comparing AND list_has_any(tokens, {DATASET_WORDS}) THEN 'dataset_comparison' WHEN {_about(METHOD_WORDS)} THEN 'methodology_comparison'
  WHEN {_about(DATASET_WORDS)} THEN 'dataset_comparison' WHEN {_about(TECHNOLOGY_WORDS)} THEN 'technology_comparison' WHEN mentioned AND ({_ANY.format(SUMMARY_PHRASES, 'raw')} OR NOT list_has_any(tokens, {[*METHOD_WORDS, *DATASET_WORDS, *TECHNOLOGY_WORDS, *GAP_WORDS]})) THEN 'paper_summary'
  WHEN list_has_any(tokens, {GAP_WORDS}) AND {_ANY.format(LIMITATION_PHRASES, 'raw')} THEN 'limitation_analysis' WHEN list_has_any(tokens, {GAP_WORDS}) OR {_ANY.format(FUTURE_PHRASES, 'raw')} THEN 'research_gap_exploration'
  WHEN {_ANY.format(TREND_PHRASES, 'raw')} THEN 'trend_analysis' WHEN {_ANY.format(EVIDENCE_PHRASES, 'raw')} THEN 'evidence_lookup' ELSE 'general_research_question' END"""


@query(f"""WITH {_QUESTIONS}, m AS (SELECT *, len(regexp_extract_all(text, '"([^"]+)"')) > 0 AS mentioned, regexp_extract(raw, '\\bwhich\\s+(.+?)\\s+(?:is|are)\\s+most', 1) AS implicit,
    len(list_filter([regexp_extract(text, '(?i)(?:compare|between)\\s+(.+?)\\s+and\\s+(.+?)(?:\\?|$|\\.)', 1), regexp_extract(text, '(?i)(?:compare|between)\\s+(.+?)\\s+and\\s+(.+?)(?:\\?|$|\\.)', 2)], lambda x: regexp_replace({_STRIP.format('x')}, '^"+|"+$', '', 'g') <> '')) AS targets FROM t),
  c AS (SELECT *, list_has_any(tokens, {COMPARE_WORDS}) OR targets > 0 AS comparing FROM m) SELECT conv_id, turn, {_INTENT} AS intent FROM c""")
def classify_questions(c: Corpus) -> DataFrame:
    return R.classified(c.table("conversations").where("role = 'user'").select("conv_id", "turn", "text")).select("conv_id", "turn", "intent")


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS c, regexp_replace(lower(text), '\\[.*?\\]\\s*', '', 'g') AS cleared FROM documents), i AS (SELECT item_id, {_STRIP.format('lower(text)')} AS t FROM benchmark),
  b AS (SELECT *, regexp_replace(t, '\\s*\\([^)]*\\)\\s*', '', 'g') AS u, regexp_extract_all(t, '[a-zA-Z0-9]{{4,}}') AS w FROM i), n AS (SELECT *, {_STRIP.format('u')} AS bare FROM b),
  f AS (SELECT item_id, doc_id FROM n, d WHERE t <> '' AND (contains(c, t) OR (bare <> '' AND (contains(c, bare) OR contains(cleared, bare))) OR (len(w) > 0 AND len(list_filter(w, lambda x: contains(c, x))) >= greatest(3, len(w) // 2))))
  SELECT item_id, doc_id, true AS found FROM f UNION ALL SELECT item_id, NULL, false FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM f)""")
def validate_citations(c: Corpus) -> DataFrame:
    return R.citations(c.table("documents").select("doc_id", "text"), c.table("benchmark").select("item_id", F.col("text").alias("title")))


@query(f"""WITH {_SCORED}, a AS (SELECT source, count(*) AS total, count_if(kw > 32) AS positive, sum(chars) AS chars, count_if(lang IS NOT NULL) AS examined, count_if(lang = 'en') AS kept, avg(kw) AS m, avg(sem) AS model FROM sc GROUP BY 1)
  SELECT source, round(0.25 * positive / total + 0.1 * least(chars / 28000, 1) + 0.15 * CASE WHEN examined > 0 THEN kept / examined ELSE 1 END + 0.05 * kept / (kept + 3) + 0.15 * least(m / 100, 1) + 0.3 * model, 2)::DOUBLE AS confidence FROM a""")
def calibrate_confidence(c: Corpus) -> DataFrame:
    """Sources by their documents: those with keyword points count as useful, English ones as citations that hold."""
    kw, semantic = R.keyword_score(QUESTION, F.col("text"), F.col("lang")), content_overlap(F.coalesce("text", F.lit("")), F.lit(_ASKED))
    d = c.table("documents").select("source", "lang", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), kw.alias("kw"), semantic.alias("sem"))
    a = d.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("kw") > 32).alias("positive"), F.sum("n_chars").alias("chars"), F.count("lang").alias("examined"), F.count_if(F.col("lang") == "en").alias("kept"), F.avg("kw").alias("m"), F.avg("sem").alias("model")
    )
    col = F.col
    return a.select("source", R.confidence(col("positive"), col("total"), col("chars"), 28000, col("examined"), col("kept"), col("m"), col("model")).alias("confidence"))


@query("SELECT conv_id, md5(string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || left(text, 2000), chr(10) ORDER BY turn)) AS history FROM conversations GROUP BY 1")
def conversation_history(c: Corpus) -> DataFrame:
    return R.history(c.table("conversations"), "conv_id", "turn").select("conv_id", F.md5(F.col("history").cast("binary")).alias("history"))


@query("SELECT doc_id % 50 AS claim_id, string_agg(DISTINCT source, '|' ORDER BY source) AS papers FROM documents GROUP BY 1")
def group_citations(c: Corpus) -> DataFrame:
    m = c.table("documents").select((F.col("doc_id") % 50).alias("claim"), F.col("source").alias("paper_title"))
    return R.grouped_citations(m).withColumnRenamed("claim", "claim_id")


@query()
def embed_documents(c: Corpus) -> DataFrame:
    chunks = R.chunked(c.table("documents"), "doc_id", "text")
    return R.embed(chunks, "content").select("doc_id", "chunk_index", "embedding")


def _document_chunks(c: Corpus) -> DataFrame:
    """source, label (a document's first line), pos and content of all chunks of documents. pos numbers documents, then chunks: a
    string has fewer than 2^22 of these."""
    d = c.table("documents").select(F.struct("doc_id", "source", F.substring_index("text", "\n", 1).alias("label")).alias("of"), "text")
    return R.chunked(d, "of", "text").select("of.source", "of.label", (F.shiftleft(F.col("of.doc_id").cast("long"), 22) + F.col("chunk_index")).alias("pos"), "content")


def _artifacts(c: Corpus) -> DataFrame:
    """A gap report and a landscape for each source, as JSON payloads. A report has the gaps that its section shows: the first of a source."""
    from ..operators.graph import top_n
    from ..operators.sections import GAPS

    d = top_n(c.table("documents").select("source", "doc_id", F.col("text").alias("t")), GAPS, ["source"], [F.col("doc_id")])
    gap = d.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.col("t").alias("title"), F.lit("d").alias("description")))).alias("gaps"))
    land = c.table("documents").groupBy("source", F.col("lang").alias("name")).agg(F.count("*").alias("count")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("name", "count"))).alias("datasets"))
    one = gap.select(F.col("source").alias("id"), F.lit("research_gap_report").alias("artifact_type"), F.to_json(F.struct("gaps")).alias("payload"))
    return one.unionByName(land.select(F.col("source").alias("id"), F.lit("research_landscape").alias("artifact_type"), F.to_json(F.struct("datasets")).alias("payload")))


@query("""WITH g AS (SELECT source AS id, 'Gap Report' AS source, 'Research Gaps' AS label, string_agg(text || ': d', chr(10) ORDER BY doc_id) AS content FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 15) GROUP BY 1),
  l AS (SELECT id, 'Landscape' AS source, 'Datasets' AS label, string_agg(lang, chr(10) ORDER BY lang) AS content FROM (SELECT DISTINCT source AS id, lang FROM documents) GROUP BY 1)
  SELECT id, source, label, md5(content) AS content FROM g UNION ALL SELECT id, source, label, md5(content) FROM l""")
def artifact_sections(c: Corpus) -> DataFrame:
    from ..operators.sections import sections

    return sections(_artifacts(c)).withColumn("content", F.md5(F.col("content").cast("binary")))


@query()
def retrieve_by_keywords(c: Corpus) -> DataFrame:
    from ..operators.sections import keyword_retrieval

    return keyword_retrieval(_document_chunks(c), {"keywords": ["the", "of"], "bigrams": [], "phrases": []})


def _questions(c: Corpus) -> DataFrame:
    """All user turns of conversations, analysed and classified; question_id numbers turns within conversations."""
    turns = c.table("conversations").where("role = 'user'").select((F.shiftleft(F.col("conv_id").cast("long"), 16) + F.col("turn")).alias("question_id"), "text")
    return R.classified(R.analyzed(turns))


@query()
def retrieve_semantically(c: Corpus) -> DataFrame:
    """All user turns against an index of the chunks of all documents."""
    from ..operators import vectors
    from ..operators.sections import semantic_retrieval

    chunks = _document_chunks(c)
    index = vectors.build(R.embed(chunks, "content", 64), "pos")
    found = semantic_retrieval(index, chunks, R.embed(_questions(c), "text", 64))
    return found.select("question_id", "pos", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.round("score", 6).alias("score"), "char_count")


@query()
def question_sections(c: Corpus) -> DataFrame:
    """The ten best chunks of all documents by keywords, for every user turn."""
    from ..operators.scoring import best_sections

    return best_sections(_questions(c), _document_chunks(c), 10)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS s FROM v q, v WHERE q.vec_id % 50 = 0)
  SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def vector_search_exact(c: Corpus) -> DataFrame:
    """Vectors whose id is divisible by 50 against all, in blocks of an index that is read whole."""
    from ..operators import vectors

    e = c.table("embeddings")
    return vectors.search(vectors.build(e), e.where("vec_id % 50 = 0"), 10, "vec_id", probes=None).withColumn("score", F.round("score", 6))


@query()
def vector_index_search(c: Corpus) -> DataFrame:
    """The same by the index: tests hold its recall against brute force."""
    from ..operators import vectors

    e = c.table("embeddings")
    return vectors.search(vectors.build(e), e.where("vec_id % 50 = 0"), 10, "vec_id").withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click') AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def active_executions(c: Corpus) -> DataFrame:
    from ..operators.sections import with_active

    e = c.table("events").select("user_id", "event_type")
    items = e.where("event_type in ('view', 'click')").select("user_id").distinct()
    return with_active(items, e.select("user_id", F.when(F.col("event_type") == "error", "running").otherwise("done").alias("status")), "user_id")


@query("SELECT CASE WHEN event_type = 'error' THEN 'failed' END AS reason, count(*) AS n FROM events GROUP BY 1")
def extraction_statistics(c: Corpus) -> DataFrame:
    from ..operators.sections import batch_statistics

    return batch_statistics(c.table("events").select(F.when(F.col("event_type") == "error", "failed").alias("reason")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent')")
def filter_investigations(c: Corpus) -> DataFrame:
    from ..operators.sections import filtered_list

    o = c.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return filtered_list(o, "F", "URGENT", ["o_orderpriority"]).select("id")
