"""Queries: text functions, validation, ranking, duplicates, filters, joins and sinks of papers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aliases, text
from ..operators import ranking, resolve, sinks, validation
from ..operators.tables import Table
from ..session import shared_folder
from ..sources.corpus import Corpus, sql
from .registry import query

YEAR = 2010
TITLE_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(sql("raw_papers", f"SELECT pos, {TITLE_SQL.format('title')} AS norm_title, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '/+$', '') AS norm_url, left(sha256(title), 16) AS key FROM raw_papers"))
def fn_titles_urls(c: Corpus) -> DataFrame:
    return c.raw_papers().select("pos", text.normalized_title(F.col("title")).alias("norm_title"), text.normalized_url(F.col("url")).alias("norm_url"), text.retrieval_key(F.col("title")).alias("key"))


@query("""SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_type), '[^\\w\\s-]', ' ', 'g'), '(ing|tion|ions|s|es|ed|ment|ments|al)$', '')) AS term,
    split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS author FROM part""")
def fn_terms_authors(c: Corpus) -> DataFrame:
    p = c.table("part").select("p_partkey", "p_type", "p_name")
    comma = F.concat(F.substring_index("p_name", " ", 1), F.lit(", "), F.substring_index("p_name", " ", -1))
    return p.select(F.col("p_partkey").alias("id"), text.normalized_term(F.col("p_type")).alias("term"), text.normalized_author(comma).alias("author"))


@query(f"SELECT kind, alias AS raw, canonical AS resolved FROM {aliases.values_sql(aliases.GRAPH)} UNION ALL SELECT kind, 'x ' || alias, 'X ' || upper(alias) FROM {aliases.values_sql(aliases.GRAPH)} UNION ALL SELECT 'dataset', p_name, p_name FROM part")
def fn_entity_resolver(c: Corpus) -> DataFrame:
    """Every alias, names that only look like one, and the names of parts."""
    known = aliases.alias_table(c.spark, aliases.GRAPH).select("kind", F.col("alias").alias("a"))
    other = known.select("kind", F.concat(F.lit("x "), "a").alias("a"))
    raw = known.unionByName(other).select("kind", "a", F.concat(F.lit("  "), F.upper("a"), F.lit(" ")).alias("raw"))
    parts = c.table("part").select(F.lit("dataset").alias("kind"), F.col("p_name").alias("a"), F.concat(F.col("p_name"), F.lit("\t")).alias("raw"))
    return aliases.resolved(raw.unionByName(parts), "kind", "raw", aliases.GRAPH).select("kind", F.col("a").alias("raw"), "resolved")


@query(f"SELECT kind, alias AS raw, canonical AS resolved FROM {aliases.values_sql(aliases.EXTRACTION)} UNION ALL SELECT kind, 'no ' || alias, 'no ' || alias FROM {aliases.values_sql(aliases.EXTRACTION)} UNION ALL SELECT 'technology', p_type, p_type FROM part")
def fn_extraction_aliases(c: Corpus) -> DataFrame:
    """Every alias, names that only look like one, and the types of parts, with white space to squeeze."""
    known = aliases.alias_table(c.spark, aliases.EXTRACTION).select("kind", F.col("alias").alias("a"))
    more = known.select("kind", F.concat(F.lit("no "), "a").alias("a")).unionByName(c.table("part").select(F.lit("technology").alias("kind"), F.col("p_type").alias("a")))
    raw = known.unionByName(more).select("kind", "a", F.concat(F.lit(" "), F.replace("a", F.lit(" "), F.lit("  ")), F.lit("  ")).alias("raw"))
    return aliases.resolved(raw, "kind", "raw", aliases.EXTRACTION, squeezed=True).select("kind", F.col("a").alias("raw"), "resolved")


_INSTITUTIONS = [("University of {}", "university"), ("{} Research Centre", "lab"), ("Google {}", "company"), ("Ministry of {}", "government"), ("{}", "other"), ("OpenAI lab, {}", "lab"), ("{} college of INC", "university")]
_TECHNOLOGIES = [("PyTorch {}", "framework"), ("{} numpy", "library"), ("docker for {}", "tool"), ("{}", "other"), ("Flask and CUDA, {}", "framework")]
_KIND = "{}[(s_suppkey % {} + 1)::INT]"


@query(f"SELECT s_suppkey AS id, {_KIND.format([k for _, k in _INSTITUTIONS], len(_INSTITUTIONS))} AS institution_kind, {_KIND.format([k for _, k in _TECHNOLOGIES], len(_TECHNOLOGIES))} AS technology_kind FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def fn_classify(c: Corpus) -> DataFrame:
    """Names of nations and suppliers, worded so that every rule decides for some; the SQL states the kinds."""
    s = c.table("supplier").select("s_suppkey", "s_name", "s_nationkey").join(c.table("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))

    def worded(name: str, forms: list[tuple[str, str]]) -> Column:
        each = F.array(*[F.concat(F.lit(x.split("{}")[0]), F.col(name), F.lit(x.split("{}")[1])) for x, _ in forms])
        return F.element_at(each, (F.col("s_suppkey") % len(forms) + 1).cast("int"))

    return s.select(F.col("s_suppkey").alias("id"), text.kind_of(worded("n_name", _INSTITUTIONS), text.INSTITUTION_KINDS).alias("institution_kind"), text.kind_of(worded("s_name", _TECHNOLOGIES), text.TECHNOLOGY_KINDS).alias("technology_kind"))


@query("""SELECT p_partkey AS id, round(least(0.5 + CASE WHEN length(p_name) >= 10 THEN 0.2 WHEN length(p_name) >= 5 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(substr(p_name, 2), '[A-Z]') THEN 0.1 ELSE 0 END
    + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END, 1.0), 2)::DOUBLE AS confidence FROM part WHERE length(p_name) >= 2""")
def fn_entity_confidence(c: Corpus) -> DataFrame:
    p = c.table("part").select("p_partkey", "p_name", "p_size")
    return p.where(text.is_entity_name(F.col("p_name"))).select(F.col("p_partkey").alias("id"), text.entity_confidence(F.lit("dataset"), F.col("p_name"), F.col("p_size") > 25).alias("confidence"))


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
    u AS (SELECT a.item_id AS a, b.item_id AS b, a.w AS x, b.w AS y FROM t a JOIN t b ON b.item_id = a.item_id + 1)
    SELECT a, b, round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0 END, 4) AS overlap FROM u""")
def fn_content_overlap(c: Corpus) -> DataFrame:
    b = c.table("benchmark").select("item_id", "text")
    n = b.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("other"))
    return b.join(n, F.col("item_id") == F.col("a")).select("a", "b", F.round(text.content_overlap(F.col("text"), F.col("other")), 4).alias("overlap"))


_KEYS = {k: f"nullif(regexp_replace(lower({k}), '^\\s+|\\s+$', '', 'g'), '')" for k in ("doi", "title", "url")}
_VALID = f"""WITH k AS (SELECT *, {_KEYS['doi']} AS kd, {_KEYS['title']} AS kt, {_KEYS['url']} AS ku FROM raw_papers),
d AS (SELECT *, kd IS NOT NULL AND count(*) OVER (PARTITION BY kd) > 1 AS dd, kt IS NOT NULL AND count(*) OVER (PARTITION BY kt) > 1 AS dt, ku IS NOT NULL AND count(*) OVER (PARTITION BY ku) > 1 AS du FROM k),
i AS (SELECT pos, list_filter([CASE WHEN dd THEN 'duplicate_doi' END, CASE WHEN dt THEN 'duplicate_title' END, CASE WHEN du THEN 'duplicate_url' END, CASE WHEN kt IS NULL THEN 'empty_title' END,
    CASE WHEN coalesce(regexp_replace(abstract, '\\s+', '', 'g'), '') = '' THEN 'missing_abstract' END, CASE WHEN len(authors) = 0 THEN 'missing_authors' END, CASE WHEN venue = '' THEN 'missing_venue' END,
    CASE WHEN year > {YEAR} THEN 'future_year' END, CASE WHEN year < 1900 THEN 'invalid_year' END, CASE WHEN citations < 0 THEN 'invalid_citation_count' END,
    CASE WHEN NOT regexp_matches(doi, '^10\\.\\d{{4,}}/[\\w.\\-;()/:<>]+$') THEN 'invalid_doi_format' END, CASE WHEN NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]+') THEN 'invalid_url' END], lambda x: x IS NOT NULL) AS issues FROM d),
p AS (SELECT pos, issues, list_has_any(issues, {validation.CRITICAL}) AS critical, 100 - coalesce(list_sum(list_transform(issues, lambda x: CASE {' '.join(f"WHEN x = '{k}' THEN {v}" for k, v in validation.PENALTIES.items())} ELSE 0 END)), 0) AS left_over FROM i),
v AS (SELECT pos, array_to_string(issues, ',') AS issues, (CASE WHEN critical THEN 0 ELSE greatest(left_over, 0) END)::BIGINT AS score FROM p),
s AS (SELECT *, CASE WHEN score >= 90 THEN 'valid' WHEN score >= 70 THEN 'warning' ELSE 'invalid' END AS status FROM v)"""


@query(sql("raw_papers", f"{_VALID} SELECT * FROM s"))
def validate_papers(c: Corpus) -> DataFrame:
    v = validation.scored(validation.with_issues(c.raw_papers(), YEAR))
    return v.select("pos", F.array_join("issues", ",").alias("issues"), F.col("score").cast("long").alias("score"), "status")


@query(sql("raw_papers", f"{_VALID} SELECT count(*) AS total, count_if(status = 'valid')::BIGINT AS valid, count_if(status = 'warning')::BIGINT AS warning, count_if(status = 'invalid')::BIGINT AS invalid, count_if(issues LIKE '%duplicate_%')::BIGINT AS duplicates, coalesce(round(avg(score), 1), 0) AS average_score FROM s"))
def validation_summary(c: Corpus) -> DataFrame:
    return validation.summary(validation.scored(validation.with_issues(c.raw_papers(), YEAR)))


_RECENCY = f"CASE WHEN coalesce(year, 0) = 0 THEN 0 WHEN {YEAR} - year <= 0 THEN 1 ELSE 1 / (1 + ln(1 + {YEAR} - year)) END"
_CITED = "CASE WHEN citations > 0 AND m > 0 THEN ln(1 + citations) / ln(1 + m) ELSE 0 END"


@query(sql("raw_papers", f"""WITH r AS (SELECT *, max(citations) OVER () AS m FROM raw_papers),
  s AS (SELECT pos, 100 * (0.35 * {_CITED} + 0.25 * {_RECENCY} + 0.2 * (((coalesce(length(abstract), 0) > 50)::INT + (len(authors) > 0)::INT + (coalesce(doi, '') <> '')::INT + (venue <> '')::INT + (coalesce(year, 0) <> 0)::INT) / 5.0)
    + 0.2 * CASE source WHEN 'semantic_scholar' THEN 1.0 WHEN 'openalex' THEN 0.9 WHEN 'arxiv' THEN 0.7 ELSE 0.5 END) AS raw FROM r)
  SELECT pos, round(raw, 2)::DOUBLE AS score, row_number() OVER (ORDER BY round(raw, 6) DESC, pos) AS rank FROM s"""))
def rank_papers(c: Corpus) -> DataFrame:
    _shared(c)
    ranked = ranking.rank(c.raw_papers(), YEAR).select("pos", "score", F.round("raw_score", 6).alias("_r"))
    return ranking.numbered(ranked, [F.desc("_r"), F.col("pos")], "rank").select("pos", "score", "rank")


@query(sql("raw_papers", f"WITH r AS (SELECT *, max(citations) OVER () AS m FROM raw_papers) SELECT pos, round(0.25 + 0.3 * {_CITED} + 0.2 * {_RECENCY}, 4)::DOUBLE AS score FROM r"))
def rank_papers_legacy(c: Corpus) -> DataFrame:
    return ranking.legacy_rank(c.raw_papers(), YEAR).select("pos", "score")


@query(sql("raw_papers", "SELECT source, count(*) AS fetched, count(DISTINCT lower(title)) AS unique_titles, round(avg(citations), 2) AS mean_citations, count(*) - count(DISTINCT lower(title)) AS removed FROM raw_papers GROUP BY source"))
def retrieval_metrics(c: Corpus) -> DataFrame:
    return ranking.retrieval_metrics(c.raw_papers())


@query(sql("raw_papers", "SELECT pos, year, source FROM raw_papers WHERE (contains(lower(title), 'the') OR contains(lower(coalesce(abstract, '')), 'the') OR contains(lower(venue), 'the') OR len(list_filter(authors, lambda a: contains(lower(a), 'the'))) > 0) AND year BETWEEN 1950 AND 2000 AND source = 'openalex' AND citations >= 5"))
def filter_papers(c: Corpus) -> DataFrame:
    return c.raw_papers().where(ranking.matches("The", (1950, 2000), "OpenAlex", 5)).select("pos", "year", "source")


_SORTS = {"newest": "year DESC NULLS LAST", "oldest": "year NULLS LAST", "most_cited": "coalesce(citations, 0) DESC", "alphabetical": "title COLLATE en"}


@query(sql("raw_papers", " UNION ALL ".join(f"SELECT '{mode}' AS mode, pos, row_number() OVER (ORDER BY {by}, pos) AS position FROM raw_papers" for mode, by in _SORTS.items())))
def sort_papers(c: Corpus) -> DataFrame:
    _shared(c)
    out = None
    for mode in ranking.SORT_MODES:
        numbered = ranking.numbered(c.raw_papers().select("pos", "title", "year", "citations"), ranking.sort_order(mode), "position")
        part = numbered.select(F.lit(mode).alias("mode"), "pos", "position")
        out = part if out is None else out.unionByName(part)
    return out


@query(sql("raw_papers", "SELECT (SELECT string_agg(DISTINCT source, ',' ORDER BY source) FROM raw_papers) AS providers, min(year) AS min_year, max(year) AS max_year FROM raw_papers"))
def paper_facets(c: Corpus) -> DataFrame:
    return ranking.facets(c.raw_papers())


@query(sql("raw_papers", f"""WITH k AS (SELECT *, {TITLE_SQL.format('title')} AS nt FROM raw_papers)
  SELECT pos, source FROM k QUALIFY row_number() OVER (PARTITION BY CASE WHEN nt = '' THEN 'pos:' || pos ELSE nt END ORDER BY pos) = 1"""))
def deduplicate_by_title(c: Corpus) -> DataFrame:
    key = text.normalized_title(F.col("title"))
    return resolve.single_key(c.raw_papers(), F.when(key != "", key)).select("pos", "source")


_RESOLVED = f"""WITH RECURSIVE k AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i, list_filter(['doi:' || {_KEYS['doi']}, 'title:' || {_KEYS['title']}, 'norm:' || nullif({TITLE_SQL.format('title')}, ''),
    'url:' || nullif(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '/+$', ''), '')], lambda x: x IS NOT NULL) AS keys FROM raw_papers),
  walk AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS pos, NULL::BIGINT AS "group", []::VARCHAR[] AS owned, []::BIGINT[] AS owners
    UNION ALL SELECT i, pos, coalesce(hit, pos), CASE WHEN hit IS NULL THEN list_concat(owned, keys) ELSE owned END, CASE WHEN hit IS NULL THEN list_concat(owners, list_transform(keys, lambda x: pos)) ELSE owners END
      FROM (SELECT k.i, k.pos, k.keys, walk.owned, walk.owners, list_min(list_transform(list_filter(k.keys, lambda x: list_contains(walk.owned, x)), lambda x: walk.owners[list_position(walk.owned, x)])) AS hit FROM walk JOIN k ON k.i = walk.i + 1)),
  resolved AS (SELECT pos, "group" FROM walk WHERE i > 0)"""
_FIELDS = ["title", "abstract", "doi", "url", "venue", "year", "citations"]


@query(sql("raw_papers", f'{_RESOLVED} SELECT pos, "group" FROM resolved'))
def resolve_duplicates(c: Corpus) -> DataFrame:
    _shared(c)
    return resolve.greedy_groups(c.raw_papers())


@query(sql("raw_papers", f"""{_RESOLVED} SELECT "group", {', '.join(f"arg_min({x}, pos) FILTER ({x}::VARCHAR <> '') AS {x}" for x in _FIELDS)}, array_to_string((list(authors ORDER BY len(authors) DESC, pos))[1], '|') AS authors,
  string_agg(DISTINCT source, ',' ORDER BY source) AS merged_from, count(*) AS copies FROM raw_papers JOIN resolved USING (pos) GROUP BY 1"""))
def merge_duplicates(c: Corpus) -> DataFrame:
    _shared(c)
    return resolve.merged(c.raw_papers()).withColumn("authors", F.array_join("authors", "|"))


@query(sql("raw_papers", f"""{_RESOLVED}, given AS ({' UNION ALL '.join(f"SELECT pos, source, '{x}' AS field FROM raw_papers WHERE {x} IS NOT NULL" for x in _FIELDS)}),
  once AS (SELECT "group", field, source, min(pos) AS pos FROM given JOIN resolved USING (pos) GROUP BY ALL) SELECT "group", field, string_agg(source, ',' ORDER BY pos) AS providers FROM once GROUP BY ALL"""))
def merge_provenance(c: Corpus) -> DataFrame:
    _shared(c)
    return resolve.provenance(c.raw_papers(), resolve.greedy_groups(c.raw_papers()))


def _shared(c: Corpus) -> None:
    from ..session import checkpoints

    checkpoints(c.spark)


@query(sql("papers", "SELECT p.investigation_id, p.paper_id, p.year, p.citations, row_number() OVER (PARTITION BY investigation_id ORDER BY citations DESC, paper_id) AS rank FROM papers p JOIN customer ON c_custkey = investigation_id WHERE c_mktsegment = 'BUILDING'"))
def investigation_papers(c: Corpus) -> DataFrame:
    who = c.table("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("investigation_id"))
    w = Window.partitionBy("investigation_id").orderBy(F.desc("citations"), "paper_id")
    return c.papers().join(who, "investigation_id").select("investigation_id", "paper_id", "year", "citations", F.row_number().over(w).cast("long").alias("rank"))


@query(sql("papers authors", "SELECT p.paper_id, p.investigation_id, min(a.name) AS first_author, count(a.name) AS authors FROM papers p LEFT JOIN authors a ON a.paper_id = p.paper_id GROUP BY ALL"))
def list_papers(c: Corpus) -> DataFrame:
    first = c.authors().groupBy("paper_id").agg(F.min("name").alias("first_author"), F.count("*").alias("authors"))
    return c.papers().select("paper_id", "investigation_id").join(first, "paper_id", "left").withColumn("authors", F.coalesce("authors", F.lit(0)))


@query(sql("raw_papers", """WITH e AS (SELECT pos AS id, lower(doi) AS doi, title FROM raw_papers WHERE pos % 2 = 0), d AS (SELECT doi, min(id) AS id FROM e WHERE doi <> '' GROUP BY doi), t AS (SELECT title, min(id) AS id FROM e WHERE title <> '' GROUP BY title),
  n AS (SELECT * FROM raw_papers WHERE pos % 2 = 1)
  SELECT n.pos, coalesce(d.id, t.id, n.pos) AS paper_id, CASE WHEN d.id IS NOT NULL THEN 'doi' WHEN t.id IS NOT NULL THEN 'title' ELSE 'new' END AS matched_by FROM n LEFT JOIN d ON d.doi = lower(n.doi) LEFT JOIN t ON t.title = n.title"""))
def persist_papers(c: Corpus) -> DataFrame:
    p = c.raw_papers().select("pos", "doi", "title")
    stored = p.where("pos % 2 = 0").select(F.col("pos").alias("id"), "doi", "title")
    return sinks.match_existing(p.where("pos % 2 = 1"), stored).select("pos", "paper_id", "matched_by")


@query(sql("papers", "SELECT investigation_id, paper_id FROM papers WHERE year = 1998 AND paper_id NOT IN (SELECT paper_id FROM papers WHERE citations > 100)"))
def attach_missing(c: Corpus) -> DataFrame:
    p = c.papers().select("investigation_id", "paper_id", "year", "citations")
    have = p.where("citations > 100").select("investigation_id", "paper_id")
    return sinks.only_new(p.where("year = 1998").select("investigation_id", "paper_id"), have, ["investigation_id", "paper_id"])


@query("""WITH old AS (SELECT o_orderkey AS id, 'unread' AS status FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_orderkey AS id, 'reading' AS status FROM orders WHERE o_orderkey % 2 = 0)
  SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status FROM old o FULL JOIN new n ON n.id = o.id""")
def upsert_reading_status(c: Corpus) -> DataFrame:
    o = c.table("orders").select(F.col("o_orderkey").alias("id"))
    return sinks.upserted(o.where("id % 3 = 0").withColumn("status", F.lit("unread")), o.where("id % 2 = 0").withColumn("status", F.lit("reading")), ["id"])


@query("SELECT event_id, event_type FROM events WHERE NOT (event_type = 'error' AND user_id % 2 = 0)")
def delete_where(c: Corpus) -> DataFrame:
    return sinks.without(c.table("events").select("event_id", "event_type", "user_id"), (F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)).select("event_id", "event_type")


@query("""WITH old AS (SELECT o_orderkey AS id, 'unread' AS status FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_orderkey AS id, 'reading' AS status FROM orders WHERE o_orderkey % 2 = 0),
  merged AS (SELECT coalesce(n.id, o.id) AS id, coalesce(n.status, o.status) AS status FROM old o FULL JOIN new n ON n.id = o.id),
  more AS (SELECT * FROM merged UNION ALL SELECT o_orderkey, 'later' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey NOT IN (SELECT id FROM merged))
  SELECT id, status FROM more WHERE NOT (status = 'reading' AND id % 7 = 0)""")
def stored_reading_status(c: Corpus) -> DataFrame:
    """A stored table after an upsert, an insert of what is absent and a delete; the table stays in the shared folder."""
    o = c.table("orders").select(F.col("o_orderkey").alias("id"))
    of = lambda n, status: o.where(F.col("id") % n == 0).withColumn("status", F.lit(status))
    table = Table.made(of(3, "unread"), f"{shared_folder(c.spark).rstrip('/')}/table-{uuid.uuid4().hex}", ["id"])
    table.upsert(of(2, "reading"))
    table.upsert(of(5, "later"), keep=True)
    table.delete((F.col("status") == "reading") & (F.col("id") % 7 == 0))
    table.cleaned()
    return table.rows()


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'translate' ELSE 'new' END AS status, md5(text) AS digest FROM documents WHERE NOT coalesce(n_chars < 200, false)""")
def stored_documents(c: Corpus) -> DataFrame:
    """Whole documents as a stored table: made, German ones put in place with another status, all of them offered again (which adds
    nothing), short ones deleted. The table stays in the shared folder."""
    new = c.table("documents").select("doc_id", "lang", "n_chars", "text").withColumn("status", F.lit("new"))
    table = Table.made(new, f"{shared_folder(c.spark).rstrip('/')}/table-{uuid.uuid4().hex}", ["doc_id"])
    table.upsert(new.where("lang = 'de'").withColumn("status", F.lit("translate")))
    table.upsert(new, keep=True)
    table.delete(F.col("n_chars") < 200)
    table.cleaned()
    return table.rows().select("doc_id", "status", F.md5(F.col("text").cast("binary")).alias("digest"))
