"""Queries: the research graph, trends and institutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import INSTITUTION_KINDS, TECHNOLOGY_KINDS, kind_of, kind_sql
from ..operators import graph, institutions
from ..sources.corpus import Corpus, sql
from .registry import query

_ENTRIES = """WITH cited AS (SELECT i.name AS institution, p.paper_id, p.citations, p.year FROM institutions i JOIN papers p ON p.paper_id = i.paper_id),
base AS (SELECT institution, count(*) AS paper_count, coalesce(sum(citations), 0)::BIGINT AS citation_count, round(sum(citations) / greatest(count(*), 1), 2) AS avg_citations FROM cited GROUP BY 1),
yr AS (SELECT institution, year, count(*) AS n FROM cited GROUP BY 1, 2), st AS (SELECT *, lag(n) OVER (PARTITION BY institution ORDER BY year) AS b, row_number() OVER (PARTITION BY institution ORDER BY year DESC) AS k FROM yr),
rate AS (SELECT institution, round(coalesce((n - b) / greatest(b, 1), 0), 4) AS growth_rate FROM st WHERE k = 1),
au AS (SELECT i.name AS institution, count(DISTINCT a.name) AS author_count FROM institutions i JOIN authors a ON a.paper_id = i.paper_id GROUP BY 1),
te AS (SELECT i.name AS institution, count(DISTINCT a.name) AS technology_count FROM institutions i JOIN technologies a ON a.paper_id = i.paper_id GROUP BY 1),
dm AS (SELECT i.name AS institution, count(DISTINCT a.name) AS domain_count FROM institutions i JOIN domains a ON a.paper_id = i.paper_id GROUP BY 1),
ed AS (SELECT x.name AS a, y.name AS b, count(*) AS w FROM institutions x JOIN institutions y ON y.paper_id = x.paper_id AND x.name < y.name GROUP BY 1, 2),
dg AS (SELECT n, sum(w) AS d FROM (SELECT a AS n, w FROM ed UNION ALL SELECT b, w FROM ed) GROUP BY 1),
entries AS (SELECT base.*, growth_rate, author_count, technology_count, domain_count, coalesce(round(d / (SELECT max(d) FROM dg), 4), 0) AS collaboration_score FROM base JOIN rate USING (institution) LEFT JOIN au USING (institution) LEFT JOIN te USING (institution) LEFT JOIN dm USING (institution) LEFT JOIN dg ON n = institution)"""
_VIEWS = "papers institutions authors technologies domains"


def _entries(c: Corpus) -> DataFrame:
    return institutions.entries_of_sets(c.papers(), c.entity_sets("institution", "author", "technology", "domain"))


@query(sql(_VIEWS, f"{_ENTRIES} SELECT *, row_number() OVER (ORDER BY paper_count DESC, institution) AS rank FROM entries"))
def institution_ranking(c: Corpus) -> DataFrame:
    return institutions.ranked(_entries(c), "paper_count", 100)


_LISTS = [("top_institutions", "paper_count", "true"), ("emerging_institutions", "growth_rate", "growth_rate > 0.3"), ("most_collaborative", "collaboration_score", "true"), ("fastest_growing", "growth_rate", "true"),
    ("technology_leaders", "technology_count", "true"), ("dataset_leaders", "paper_count", "true"), ("methodology_leaders", "domain_count", "true")]


@query(sql(_VIEWS, f"{_ENTRIES} SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{k}' AS list, institution, {v}::DOUBLE AS value, row_number() OVER (ORDER BY {v} DESC, institution) AS rank FROM entries WHERE {w} QUALIFY rank <= 10)" for k, v, w in _LISTS) + ")"))
def institution_leaders(c: Corpus) -> DataFrame:
    return institutions.leaders(_entries(c), 10)


@query(sql(_VIEWS, f"""{_ENTRIES} SELECT institution, paper_count, round(domain_count / greatest(paper_count, 1), 4) AS diversity,
  concat_ws('; ', CASE WHEN paper_count > 10 THEN 'High publication output' END, CASE WHEN citation_count > 100 THEN 'High citation impact' END, CASE WHEN avg_citations > 10 THEN 'High average citations per paper' END, CASE WHEN growth_rate > 0.5 THEN 'Fast publication growth' END,
    CASE WHEN round(domain_count / greatest(paper_count, 1), 4) > 0.3 THEN 'Broad research diversity' END, CASE WHEN collaboration_score > 0.5 THEN 'Strong collaboration network' END) AS strengths,
  concat_ws('; ', CASE WHEN paper_count < 3 THEN 'Low publication output' END, CASE WHEN citation_count < 10 THEN 'Low citation impact' END, CASE WHEN avg_citations < 3 THEN 'Below-average citations per paper' END, CASE WHEN growth_rate < 0 THEN 'Declining publication trend' END,
    CASE WHEN round(domain_count / greatest(paper_count, 1), 4) < 0.1 THEN 'Narrow research focus' END, CASE WHEN collaboration_score < 0.1 THEN 'Limited collaboration network' END) AS weaknesses FROM entries WHERE institution IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') OR institution < 'F'"""))
def institution_comparison(c: Corpus) -> DataFrame:
    e = _entries(c)
    names = [r[0] for r in c.table("nation").select("n_name").where("n_name in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4') or n_name < 'F'").collect()]  # a dimension of 25 rows
    return institutions.compare(e, names).select("institution", "paper_count", "diversity", "strengths", "weaknesses")


_HOME = "home AS (SELECT DISTINCT s_name AS name, n_name AS institution FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def _home(c: Corpus) -> DataFrame:
    return c.table("supplier").join(c.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("author"), F.col("n_name").alias("institution")).distinct()


@query(sql("papers entities", f"""WITH {_HOME}, i AS (SELECT paper_id, name AS institution FROM entities WHERE type = 'institution'), o AS (SELECT i.institution, e.type AS section, e.name, count(*) AS value FROM i JOIN entities e USING (paper_id) WHERE type IN ('author', 'domain', 'technology', 'dataset', 'methodology') GROUP BY ALL),
  k AS (SELECT i.institution, 'collaborator' AS section, j.institution AS name, count(*) AS value FROM i JOIN i j ON j.paper_id = i.paper_id AND j.institution <> i.institution GROUP BY ALL),
  x AS (SELECT institution, 'co_author' AS section, name, value FROM o WHERE section = 'author' AND NOT EXISTS (SELECT 1 FROM home h WHERE h.name = o.name AND h.institution = o.institution)),
  p AS (SELECT i.institution, p.* FROM i JOIN papers p USING (paper_id)), y AS (SELECT institution, 'year' AS section, year::VARCHAR AS name, count(*) AS value FROM p GROUP BY ALL)
  SELECT institution, section, name, value, row_number() OVER (PARTITION BY institution, section ORDER BY value DESC, name) AS rank FROM o WHERE section <> 'author'
  UNION ALL SELECT *, row_number() OVER (PARTITION BY institution ORDER BY name) FROM y
  UNION ALL SELECT *, row_number() OVER (PARTITION BY institution, section ORDER BY value DESC, name) AS rank FROM (SELECT * FROM o WHERE section = 'author' UNION ALL SELECT * FROM k UNION ALL SELECT * FROM x) QUALIFY rank <= 10
  UNION ALL SELECT institution, 'paper', paper_id::VARCHAR, citations::BIGINT, row_number() OVER (PARTITION BY institution ORDER BY citations DESC, paper_id) AS rank FROM p QUALIFY rank <= 10
  UNION ALL SELECT institution, 'total', unnest(['papers', 'citations']), unnest([count(*), sum(citations)::BIGINT]), NULL FROM p GROUP BY institution
  UNION ALL SELECT institution, 'total', 'authors', count(*), NULL FROM o WHERE section = 'author' GROUP BY institution"""))
def institution_details(c: Corpus) -> DataFrame:
    return institutions.details(c.papers(), c.entity_sets("institution", "author", "technology", "domain", "dataset", "methodology"), _home(c))


@query(sql("institutions", f"SELECT {kind_sql('name', INSTITUTION_KINDS)} AS kind, name AS institution, count(*) AS papers, row_number() OVER (PARTITION BY {kind_sql('name', INSTITUTION_KINDS)} ORDER BY count(*) DESC, name) AS rank FROM institutions GROUP BY 2 QUALIFY rank <= 10"))
def institutions_by_type(c: Corpus) -> DataFrame:
    return institutions.by_type(c.institutions())


@query(sql("technologies datasets methodologies", """WITH c AS (SELECT 'technology_methodology' AS relation, a.name, b.name AS other, count(*) AS papers FROM technologies a JOIN methodologies b USING (paper_id) GROUP BY ALL
    UNION ALL SELECT 'technology_dataset', a.name, b.name, count(*) FROM technologies a JOIN datasets b USING (paper_id) GROUP BY ALL UNION ALL SELECT 'dataset_methodology', a.name, b.name, count(*) FROM datasets a JOIN methodologies b USING (paper_id) GROUP BY ALL
    UNION ALL SELECT 'dataset_technology', a.name, b.name, count(*) FROM datasets a JOIN technologies b USING (paper_id) GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY relation, name ORDER BY papers DESC, other) AS rank FROM c QUALIFY rank <= 20"""))
def what_goes_with(c: Corpus) -> DataFrame:
    return graph.goes_with(c.entity_sets("technology", "dataset", "methodology"))


@query()  # the last branch of a score is a sequence ratio, which SQL has no function for: tests compare with brute force
def institution_search(c: Corpus) -> DataFrame:
    e = c.institutions().groupBy(F.col("name").alias("institution")).agg(F.count("*").alias("paper_count"))
    out = None
    for q in ("nation_1", "nation", "on_2", "ation 7"):
        part = institutions.search(e, q).select(F.lit(q).alias("q"), "institution", "paper_count", "relevance_score")
        out = part if out is None else out.unionByName(part)
    return out


@query(sql(_VIEWS + " datasets methodologies", """WITH t AS (SELECT DISTINCT paper_id FROM (SELECT * FROM domains UNION ALL SELECT * FROM technologies UNION ALL SELECT * FROM datasets UNION ALL SELECT * FROM methodologies) WHERE contains(lower(name), 'st'))
  SELECT i.name AS institution, count(*) AS papers, sum(citations)::BIGINT AS citations, round(count(*) / (SELECT count(*) FROM t), 4) AS relevance FROM institutions i JOIN t USING (paper_id) JOIN papers p USING (paper_id) GROUP BY 1 ORDER BY papers DESC, citations DESC, institution LIMIT 10"""))
def institution_topics(c: Corpus) -> DataFrame:
    topic = institutions.topic_papers([c.domains(), c.technologies(), c.datasets(), c.methodologies()], "St")
    return institutions.topic_search(topic, c.institutions(), c.papers(), 10)


@query(sql(_VIEWS + " datasets methodologies", """WITH t AS (SELECT DISTINCT paper_id FROM (SELECT * FROM domains UNION ALL SELECT * FROM technologies UNION ALL SELECT * FROM datasets UNION ALL SELECT * FROM methodologies) WHERE contains(lower(name), 'st')),
  f AS (SELECT i.name AS institution FROM institutions i JOIN t USING (paper_id) JOIN papers p USING (paper_id) GROUP BY 1 ORDER BY count(*) DESC, sum(citations) DESC, institution LIMIT 10), o AS (SELECT f.institution, i.paper_id FROM f JOIN institutions i ON i.name = f.institution JOIN t USING (paper_id)),
  b AS (SELECT institution, 'paper' AS kind, paper_id AS id, paper_id::VARCHAR AS name, citations::BIGINT AS value FROM o JOIN papers USING (paper_id) UNION ALL SELECT institution, 'author', NULL, a.name, count(*) FROM o JOIN authors a USING (paper_id) GROUP BY ALL)
  SELECT institution, kind, name, value, row_number() OVER (PARTITION BY institution, kind ORDER BY value DESC, id, name) AS rank FROM b QUALIFY rank <= 5"""))
def institution_topic_details(c: Corpus) -> DataFrame:
    topic = institutions.topic_papers([c.domains(), c.technologies(), c.datasets(), c.methodologies()], "St")
    found = institutions.topic_search(topic, c.institutions(), c.papers(), 10)
    return institutions.topic_details(found, topic, c.institutions(), c.papers(), c.authors())


@query(sql("papers institutions datasets methodologies", """WITH cited AS (SELECT i.name AS institution, p.* FROM institutions i JOIN papers p USING (paper_id)),
  ok AS (SELECT paper_id FROM datasets WHERE contains(lower(name), '#1') INTERSECT SELECT paper_id FROM methodologies WHERE contains(lower(name), 'st'))
  SELECT institution, count(*) AS paper_count, sum(citations)::BIGINT AS citation_count FROM cited GROUP BY 1 HAVING count(*) >= 20 AND sum(citations) >= 500 AND bool_or(year BETWEEN 1996 AND 1999 AND paper_id IN (SELECT paper_id FROM ok))"""))
def institution_filter(c: Corpus) -> DataFrame:
    return institutions.filtered(c.institutions(), c.papers(), {"dataset": c.datasets(), "methodology": c.methodologies()}, 20, 500, (1996, 1999), {"dataset": ["#1"], "methodology": ["St"]})


@query(sql("institutions authors technologies", """WITH k AS (SELECT i.name AS institution, 'author' AS kind, a.name, count(*) AS papers FROM institutions i JOIN authors a USING (paper_id) GROUP BY ALL
    UNION ALL SELECT i.name, 'technology', t.name, count(*) FROM institutions i JOIN technologies t USING (paper_id) GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY institution, kind ORDER BY papers DESC, name) AS rank FROM k QUALIFY rank <= 10"""))
def institution_profiles(c: Corpus) -> DataFrame:
    return institutions.profile_lists(c.institutions(), {"author": c.authors(), "technology": c.technologies()})


@query(sql("institutions authors", """WITH home AS (SELECT DISTINCT s_name AS author, n_name AS institution FROM supplier JOIN nation ON n_nationkey = s_nationkey),
  o AS (SELECT DISTINCT i.name AS institution, a.name AS author FROM institutions i JOIN authors a USING (paper_id)) SELECT institution, count(*) AS external FROM (SELECT * FROM o EXCEPT SELECT institution, author FROM home) GROUP BY 1"""))
def institution_external_coauthors(c: Corpus) -> DataFrame:
    return institutions.external_coauthors(c.institutions(), c.authors(), _home(c))


@query(sql("institutions", f"SELECT {kind_sql('name', INSTITUTION_KINDS)} AS kind, count(DISTINCT name) AS names, count(DISTINCT paper_id) AS papers FROM institutions GROUP BY 1"))
def institution_kinds(c: Corpus) -> DataFrame:
    return c.institutions().groupBy(kind_of(F.col("name"), INSTITUTION_KINDS).alias("kind")).agg(F.countDistinct("name").alias("names"), F.countDistinct("paper_id").alias("papers"))


_PAIRS = "SELECT x.name AS a, y.name AS b, count(*) AS weight FROM {0} x JOIN {0} y ON y.paper_id = x.paper_id AND x.name < y.name GROUP BY 1, 2"


@query(sql("institutions", _PAIRS.format("institutions")))
def collaboration_edges(c: Corpus) -> DataFrame:
    return graph.pair_counts(c.institutions())


@query(sql("authors", _PAIRS.format("authors")))
def co_authorship_edges(c: Corpus) -> DataFrame:
    return graph.pair_counts(c.authors())


@query(sql("methodologies", _PAIRS.format("methodologies")))
def co_occurrence_matrix(c: Corpus) -> DataFrame:
    return graph.pair_counts(c.methodologies())


@query(sql("papers authors", """WITH e AS (SELECT p.investigation_id, x.name AS a, y.name AS b, count(*) AS w FROM authors x JOIN authors y ON y.paper_id = x.paper_id AND x.name < y.name JOIN papers p ON p.paper_id = x.paper_id GROUP BY ALL),
  d AS (SELECT investigation_id, name, sum(w)::BIGINT AS degree FROM (SELECT investigation_id, a AS name, w FROM e UNION ALL SELECT investigation_id, b, w FROM e) GROUP BY ALL)
  SELECT *, round(degree / max(degree) OVER (PARTITION BY investigation_id), 4) AS centrality FROM d"""))
def author_centrality(c: Corpus) -> DataFrame:
    bridge = c.authors().join(c.papers().select("paper_id", "investigation_id"), "paper_id")
    d = graph.weighted_degrees(graph.pair_counts(bridge, ["investigation_id"]), ["investigation_id"])
    return d.withColumn("centrality", F.round("centrality", 4))


@query(sql("datasets", "WITH d AS (SELECT name, count(*) AS degree FROM datasets GROUP BY 1) SELECT *, round(degree / (SELECT max(degree) FROM d), 4) AS centrality FROM d"))
def dataset_centrality(c: Corpus) -> DataFrame:
    return graph.paper_centrality(c.datasets()).withColumn("centrality", F.round("centrality", 4))


@query(sql("entities", "SELECT type, name, count(*) AS papers, round(count(*) / sum(count(*)) OVER (PARTITION BY type), 6) AS share FROM entities GROUP BY 1, 2"))
def entity_frequency(c: Corpus) -> DataFrame:
    return graph.frequency(c.entities()).withColumn("share", F.round("share", 6))


@query(sql("entities", "SELECT type, name, count(*) AS papers, row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, name) AS rank FROM entities GROUP BY 1, 2 QUALIFY rank <= 20"))
def top_entities(c: Corpus) -> DataFrame:
    return graph.top_n(graph.frequency(c.entities()).drop("share"), 20, ["type"], [F.desc("papers"), F.col("name")])


@query(sql("methodologies datasets", "WITH m AS (SELECT min(name) AS n FROM methodologies), s AS (SELECT DISTINCT paper_id FROM methodologies, m WHERE name = n) SELECT name, count(*) AS shared FROM datasets JOIN s USING (paper_id) GROUP BY 1 ORDER BY shared DESC, name LIMIT 10"))
def top_co_occurring(c: Corpus) -> DataFrame:
    name = c.table("part").agg(F.min("p_type")).first()[0]
    return graph.top_co_occurring(c.methodologies(), name, c.datasets(), 10)


_YEARLY = "y AS (SELECT {1} name, year, count(DISTINCT paper_id) AS papers FROM {0} JOIN papers USING (paper_id) GROUP BY ALL)"


@query(sql("papers entities", "SELECT type, name, year, count(DISTINCT paper_id) AS papers FROM entities JOIN papers USING (paper_id) WHERE type IN ('methodology', 'dataset', 'technology', 'domain') GROUP BY ALL"))
def yearly_counts(c: Corpus) -> DataFrame:
    e = c.entities().where(F.col("type").isin("methodology", "dataset", "technology", "domain"))
    return graph.yearly(e, c.papers(), ["type", "name"])


@query(sql("papers technologies", f"""WITH {_YEARLY.format('technologies', 'investigation_id,')}, s AS (SELECT *, lag(papers) OVER (PARTITION BY investigation_id, name ORDER BY year) AS b, row_number() OVER (PARTITION BY investigation_id, name ORDER BY year DESC) AS k, count(*) OVER (PARTITION BY investigation_id, name) AS years,
    min(year) OVER (PARTITION BY investigation_id, name) AS first_year, max(year) OVER () AS latest FROM y)
  SELECT investigation_id, name, first_year, year AS last_year, years, round(coalesce((papers - b) / b, 0), 4) AS growth, year >= latest - 2 AND coalesce((papers - b) / b, 0) > 0 AS emerging, years >= 2 AND coalesce((papers - b) / b, 0) < 0 AS declining FROM s WHERE k = 1"""))
def technology_trends(c: Corpus) -> DataFrame:
    bridge = c.technologies().join(c.papers().select("paper_id", "investigation_id"), "paper_id")
    t = graph.trends(graph.yearly(bridge, c.papers().select("paper_id", "year"), ["investigation_id", "name"]), ["investigation_id", "name"])
    return t.withColumn("growth", F.round("growth", 4))


@query(sql("papers datasets", """WITH c AS (SELECT investigation_id, name, count(*) AS n FROM datasets JOIN papers USING (paper_id) GROUP BY ALL)
  SELECT investigation_id, name, n, round((n - avg(n) OVER w) / coalesce(nullif(stddev_samp(n) OVER w, 0), 1), 4) AS z FROM c WINDOW w AS (PARTITION BY investigation_id)"""))
def entity_z_scores(c: Corpus) -> DataFrame:
    n = c.datasets().join(c.papers().select("paper_id", "investigation_id"), "paper_id").groupBy("investigation_id", "name").agg(F.count("*").alias("n"))
    return graph.z_scores(n, "n", ["investigation_id"]).withColumn("z", F.round("z", 4))


@query(sql("papers", "SELECT investigation_id, round(quantile_cont(citations::DOUBLE, 0), 4) AS p0, round(quantile_cont(citations::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(citations::DOUBLE, 0.9), 4) AS p90, round(quantile_cont(citations::DOUBLE, 1), 4) AS p100 FROM papers GROUP BY 1"))
def citation_percentiles(c: Corpus) -> DataFrame:
    p = graph.percentiles(c.papers(), "citations", ["investigation_id"], [0, 50, 90, 100])
    return p.select("investigation_id", *[F.round(x, 4).alias(x) for x in ("p0", "p50", "p90", "p100")])


@query(sql("papers entities", f"SELECT type, name, count(DISTINCT paper_id) AS papers, min(year) AS first_year, CASE WHEN type = 'institution' THEN {kind_sql('name', INSTITUTION_KINDS)} WHEN type = 'technology' THEN {kind_sql('name', TECHNOLOGY_KINDS)} END AS kind FROM entities JOIN papers USING (paper_id) GROUP BY 1, 2"))
def graph_nodes(c: Corpus) -> DataFrame:
    return graph.nodes(c.papers(), c.entities())


_EDGES = """WITH own AS (SELECT 'paper:' || paper_id AS source, type || ':' || name AS target, CASE type WHEN 'author' THEN 'AUTHORED_BY' WHEN 'institution' THEN 'BELONGS_TO' WHEN 'methodology' THEN 'INTRODUCES' WHEN 'dataset' THEN 'EVALUATED_ON' WHEN 'technology' THEN 'USES' ELSE 'RELATED_TO' END AS type FROM entities WHERE type <> 'metric'),
  e AS (SELECT * FROM own UNION ALL SELECT DISTINCT 'author:' || a.name, 'institution:' || i.name, 'AFFILIATED_WITH' FROM authors a JOIN institutions i USING (paper_id))"""


@query(sql("entities authors institutions", f"{_EDGES} SELECT source || '->' || target AS id, source, target, type FROM e"))
def graph_edges(c: Corpus) -> DataFrame:
    return graph.edges(c.entity_sets(*graph.EDGE_KINDS))


@query(sql("entities authors institutions", f"{_EDGES} SELECT type, count(*) AS edges FROM e GROUP BY 1"))
def graph_edge_counts(c: Corpus) -> DataFrame:
    return graph.edges(c.entity_sets(*graph.EDGE_KINDS)).groupBy("type").agg(F.count("*").alias("edges"))


@query(sql("entities authors institutions", f"{_EDGES} SELECT source, target, type FROM e WHERE (source LIKE 'author:%' OR source LIKE 'institution:%') AND (target LIKE 'author:%' OR target LIKE 'institution:%')"))
def graph_induced(c: Corpus) -> DataFrame:
    """Among authors and institutions: edges of papers begin at none of these, so only affiliations are made."""
    sets = c.entity_sets("author", "institution")
    named = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("names")) for k in ("author", "institution")])
    nodes = sets.select(F.explode(named).alias("e")).select("e.type", F.explode("e.names").alias("name")).distinct()
    return graph.induced(graph.affiliations(sets), nodes.select(F.concat("type", F.lit(":"), "name").alias("id")))


@query(sql("entities", """WITH n AS (SELECT type, name, count(*) AS papers FROM entities WHERE type IN ('methodology', 'dataset') GROUP BY 1, 2)
  SELECT type, name, CASE type WHEN 'methodology' THEN 0 ELSE 300 END::BIGINT AS x, (row_number() OVER (PARTITION BY type ORDER BY papers DESC, name) - 1) * 80 AS y FROM n"""))
def graph_layout(c: Corpus) -> DataFrame:
    n = c.entities().where(F.col("type").isin("methodology", "dataset")).groupBy("type", "name").agg(F.count("*").alias("papers"))
    return graph.layout(n, ["methodology", "dataset"]).select("type", "name", "x", "y")


@query(sql("methodologies", """WITH s AS (SELECT name, count(*) AS n FROM methodologies GROUP BY 1), p AS (SELECT x.name AS a, y.name AS b, count(*) AS w FROM methodologies x JOIN methodologies y ON y.paper_id = x.paper_id AND x.name < y.name GROUP BY 1, 2)
  SELECT a, b, round(w / (s1.n + s2.n - w), 4) AS jaccard FROM p JOIN s s1 ON s1.name = a JOIN s s2 ON s2.name = b WHERE w / (s1.n + s2.n - w) >= 0.1"""))
def entity_similarity(c: Corpus) -> DataFrame:
    return graph.similarity(c.methodologies()).withColumn("jaccard", F.round("jaccard", 4))


@query("""WITH m AS (SELECT p_partkey AS paper_id, 'methodology' AS type, p_type AS name FROM part UNION ALL SELECT p_partkey, 'domain', p_name FROM part UNION ALL SELECT p_partkey, 'methodology', 'transformers' FROM part)
  SELECT DISTINCT paper_id, type, CASE WHEN name = 'transformers' THEN 'transformer' ELSE trim(regexp_replace(regexp_replace(lower(name), '[^\\w\\s-]', ' ', 'g'), '(ing|tion|ions|s|es|ed|ment|ments|al)$', '')) END AS name FROM m""")
def graph_build(c: Corpus) -> DataFrame:
    p = c.table("part").select(F.col("p_partkey").alias("paper_id"), "p_type", "p_name")
    raw = p.select("paper_id", F.lit("methodology").alias("type"), F.col("p_type").alias("name")).unionByName(p.select("paper_id", F.lit("domain").alias("type"), F.col("p_name").alias("name")))
    return graph.built(raw.unionByName(p.select("paper_id", F.lit("methodology").alias("type"), F.lit(" Transformers ").alias("name"))))


@query(sql("papers institutions", """WITH y AS (SELECT name, year, count(*) AS papers FROM institutions JOIN papers USING (paper_id) GROUP BY 1, 2), s AS (SELECT *, lag(papers) OVER (PARTITION BY name ORDER BY year) AS b, row_number() OVER (PARTITION BY name ORDER BY year DESC) AS k FROM y)
  SELECT name, year AS last_year, papers, round(coalesce((papers - b) / greatest(b, 1), 0), 4) AS growth FROM s WHERE k = 1"""))
def institution_trends(c: Corpus) -> DataFrame:
    counts = graph.yearly(c.institutions(), c.papers())
    last = counts.groupBy("name").agg(F.max_by("papers", "year").alias("papers"))
    g = graph.growth(counts, ["name"], floor_previous=True)
    return g.join(last, "name").select("name", "last_year", "papers", F.round("growth", 4).alias("growth"))
