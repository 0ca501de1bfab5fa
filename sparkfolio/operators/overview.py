"""A whole landscape in one table: what every analyzer of the graph finds, the totals, and observations in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INSTITUTION_KINDS, kind_of
from ..session import dropped, stored
from . import graph
from .landscape import clustered

COLUMNS = ["section", "kind", "rank", "name", "other", "value", "second"]


def rows(df: DataFrame, section: str | Column, kind: str | Column, name: Column, value: Column, rank: Column | None = None, other: Column | None = None, second: Column | None = None) -> DataFrame:
    """df as rows of a landscape: what they tell of (section, kind, rank), whom (name, other) and two numbers."""
    null = F.lit(None)
    made = [F.lit(section), F.lit(kind), null if rank is None else rank, name, null if other is None else other, value, null if second is None else second]
    kinds = ["string", "string", "long", "string", "string", "double", "double"]
    return df.select(*[c.cast(k).alias(n) for c, k, n in zip(made, kinds, COLUMNS, strict=True)])


def techniques_of(methodologies: DataFrame, techniques: DataFrame, by: list[str] = ("name",)) -> DataFrame:
    """name, technique_count, techniques (sorted): those of the papers that a methodology occurs in. Bridges of paper_id, name."""
    both = methodologies.join(techniques.select("paper_id", F.col("name").alias("_t")), "paper_id")
    return both.groupBy(*by).agg(F.sort_array(F.collect_set("_t")).alias("techniques")).withColumn("technique_count", F.size("techniques").cast("long"))


#: Type of an entity -> section of a landscape.
PLURAL = {"institution": "institutions", "methodology": "methodologies", "technology": "technologies", "dataset": "datasets", "author": "authors"}


def paper_sets(papers: DataFrame, entities: DataFrame, techniques: DataFrame) -> DataFrame:
    """paper_id, year, a sorted array of names for each type of PLURAL, and technique: a row a paper that has any name, by one shuffle."""
    both = entities.where(F.col("type").isin(*PLURAL)).select("paper_id", "type", "name").unionByName(techniques.select("paper_id", F.lit("technique").alias("type"), "name"))
    sets = [F.sort_array(F.collect_set(F.when(F.col("type") == t, F.col("name")))).alias(t) for t in (*PLURAL, "technique")]
    return both.groupBy("paper_id").agg(*sets).join(papers.select("paper_id", "year"), "paper_id", "left")


def landscape(papers: DataFrame, entities: DataFrame, techniques: DataFrame, n: int = 20) -> DataFrame:
    """The rows of COLUMNS over papers (paper_id, year) and their entities (paper_id, type, name; distinct), lists of at most n.

    institutions, methodologies, technologies, datasets: total, top (value: papers); type (of institutions, value: how many);
    first_year (of technologies); diversity (value: papers a name, second: papers that have any); temporal: total, year, span;
    collaborations: network (value: nodes, second: edges), central (value: centrality) and edge (name, other; value: papers) of
    institutions and authors; other of methodologies: its techniques.

    The entities are read once, into a table of a row a paper; see landscape_of_sets().
    """
    return landscape_of_sets(papers, paper_sets(papers, entities, techniques), n)


def landscape_of_sets(papers: DataFrame, sets: DataFrame, n: int = 20) -> DataFrame:
    """landscape() of a row a paper, as of paper_sets().

    These rows become a table; counts and edges are tables made of it, and the landscape itself is one, so that observations and
    reports read rows and run nothing again. Only that last table stays.
    """
    sets = stored(sets)
    named = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("names")) for t in PLURAL])
    of_type = sets.select("paper_id", "year", F.explode(named).alias("e")).select("paper_id", "year", "e.type", "e.names")
    counts = stored(of_type.select("type", "year", F.explode("names").alias("name")).groupBy("type", "name").agg(F.count("*").alias("papers"), F.min("year").alias("year")))
    edges = stored(graph.set_pair_counts(of_type.where(F.col("type").isin("institution", "author")), ["type"]))
    years = stored(papers.groupBy("year").agg(F.count("*").alias("papers")))
    ranked = stored(graph.top_n(counts, n, ["type"], [F.desc("papers"), F.col("name")]))
    whole = stored(landscape_rows(sets, counts, ranked, edges, years, n))
    dropped(sets, counts, ranked, edges, years)
    return whole


def landscape_rows(sets: DataFrame, counts: DataFrame, ranked: DataFrame, edges: DataFrame, years: DataFrame, n: int) -> DataFrame:
    """landscape() of paper_sets(), counts (type, name, papers, first year), the n first of each type with rank, edges (type, a, b,
    weight) and years (year, papers)."""
    name, papers_, null = F.col("name"), F.col("papers"), F.lit(None)
    section = F.create_map(*[F.lit(x) for pair in PLURAL.items() for x in pair])[F.col("type")]
    best = lambda t: ranked.where(F.col("type") == t)
    totals = counts.groupBy("type").agg(F.count("*").alias("n"), F.sum("papers").alias("all"))

    wanted = lambda t: F.broadcast(best(t).select("name"))  # noqa: E731  n rows
    met = sets.select(F.explode("institution").alias("name"), "author").join(wanted("institution"), "name").select("name", F.explode("author").alias("author"))
    authors = met.distinct().groupBy("name").agg(F.count("*").alias("authors"))
    used = sets.select(F.explode("methodology").alias("name"), "technique").join(wanted("methodology"), "name").select("name", F.explode("technique").alias("_t"))
    techniques = used.groupBy("name").agg(F.sort_array(F.collect_set("_t")).alias("techniques"))
    kind = kind_of(name, INSTITUTION_KINDS)
    types = counts.where("type = 'institution'").groupBy(kind.alias("name")).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), "name")  # a row for each kind, of which there are five
    typed = types.withColumns({"rank": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy(F.lit(1)))})
    covered = sets.agg(*[F.count_if(F.size(t) > 0).alias(t) for t in ("technology", "dataset")])
    covered = covered.select(F.explode(F.create_map(*[x for t in ("technology", "dataset") for x in (F.lit(t), F.col(t))])).alias("type", "papers"))
    first = counts.where("type = 'technology' AND year IS NOT NULL")
    newest = first.agg(F.min_by("name", F.struct(-F.col("year"), F.col("name"))).alias("name"), F.max("year").alias("year")).where("name is not null")
    dated = years.where("year is not null")
    span = dated.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null")
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))

    central = graph.weighted_degrees(edges, ["type"]).withColumn("centrality", F.round("centrality", 4))
    central = graph.top_n(central, n, ["type"], [F.desc("centrality"), name])
    heaviest = graph.top_n(edges, n, ["type"], [F.desc("weight"), F.col("a"), F.col("b")])
    networks = totals.where(F.col("type").isin("institution", "author")).join(edges.groupBy("type").agg(F.count("*").alias("e")), "type", "left")
    of_type = lambda suffix: F.concat("type", F.lit(suffix))
    out = [
        rows(totals, section, "total", null, F.col("n")),
        rows(best("institution").join(authors, "name", "left"), "institutions", "top", name, papers_, F.col("rank"), kind, F.coalesce("authors", F.lit(0))),
        rows(typed, "institutions", "type", name, F.col("n"), F.col("rank"), second=F.col("all")),
        rows(best("methodology").join(techniques, "name", "left"), "methodologies", "top", name, papers_, F.col("rank"), F.array_join("techniques", "|"), F.coalesce(F.size("techniques"), F.lit(0))),
        rows(ranked.where(F.col("type").isin("technology", "dataset")), section, "top", name, papers_, F.col("rank")),
        rows(first, "technologies", "first_year", name, F.col("year")),
        rows(newest, "technologies", "newest", name, F.col("year")),
        rows(totals.join(covered, "type"), section, "diversity", null, F.round(F.col("all") / F.col("n"), 2), second=papers_),
        rows(years.agg(F.coalesce(F.sum("papers"), F.lit(0)).alias("n")), "temporal", "total", null, F.col("n")),
        rows(dated, "temporal", "year", F.col("year"), papers_),
        rows(span, "temporal", "span", text, F.col("a"), second=F.col("b")),
        rows(networks, "collaborations", of_type("_network"), null, F.col("n"), second=F.coalesce("e", F.lit(0))),
        rows(central, "collaborations", of_type("_central"), name, F.col("centrality"), F.col("rank")),
        rows(heaviest, "collaborations", of_type("_edge"), F.col("a"), F.col("weight"), F.col("rank"), F.col("b")),
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def observations(found: DataFrame) -> DataFrame:
    """position, category, label, text: sentences about a landscape(), each from one of its rows."""
    section, kind, rank, value, second = F.col("section"), F.col("kind"), F.col("rank"), F.col("value"), F.col("second")
    whole = lambda c: c.cast("long").cast("string")
    papers = F.concat("name", F.lit(" ("), whole(value), F.lit(" papers)"))
    at = lambda s, k: (section == s) & (kind == k)
    first = lambda s: at(s, "top") & (rank == 1)
    cases = [
        (first("institutions"), "institution", "Most active institution", papers),
        (at("institutions", "type") & (rank == 1) & (second > 1), "institution", "Most common institution type", F.concat("name", F.lit(" ("), whole(value), F.lit(" institutions)"))),
        (first("methodologies"), "methodology", "Most common methodology", papers),
        (at("methodologies", "total") & (value > 0), "methodology", "Methodology diversity", F.concat(whole(value), F.lit(" distinct methodologies used"))),
        (first("technologies"), "technology", "Most used technology", papers),
        (at("technologies", "newest"), "technology", "Newest technology", F.concat("name", F.lit(" (first appeared "), whole(value), F.lit(")"))),
        (at("technologies", "diversity"), "technology", "Technology adoption rate", F.concat(value.cast("string"), F.lit(" papers per technology on average"))),
        (first("datasets"), "dataset", "Most used dataset", papers),
        (at("datasets", "diversity"), "dataset", "Dataset reuse rate", F.concat(value.cast("string"), F.lit(" papers per dataset on average"))),
        (at("temporal", "span"), "temporal", "Research time span", F.col("name")),
        (at("temporal", "total") & (value > 0), "temporal", "Total research output", F.concat(whole(value), F.lit(" papers in corpus"))),
        (at("collaborations", "institution_network"), "collaboration", "Institution collaboration intensity", F.concat(F.round(second / F.greatest(value, F.lit(1.0)), 2).cast("string"), F.lit(" collaborations per institution"))),
        (at("collaborations", "author_network") & (second > 0), "collaboration", "Author collaboration network", F.concat(whole(second), F.lit(" co-authorship connections"))),
    ]
    made = None
    for k, (when, category, label, text) in enumerate(cases, 1):
        one = F.struct(F.lit(k).cast("long").alias("position"), F.lit(category).alias("category"), F.lit(label).alias("label"), text.alias("text"))
        made = F.when(when, one) if made is None else made.when(when, one)
    return found.select(made.alias("o")).where("o is not null").select("o.*")


#: Section of a term landscape -> fields of the records that it is made of: the first that has any term.
SOURCES = {
    "methodologies": ["methodology"], "datasets": ["datasets_used", "relevant_techniques"], "evaluation_metrics": ["evaluation_metrics"], "research_domains": ["research_domains", "key_contributions"], "tasks": ["methodology"],
    "applications": ["technologies", "relevant_techniques"], "limitations": ["limitations"], "future_work": ["future_work"], "keywords": ["keywords"], "novel_contributions": ["key_contributions"], "top_authors": ["authors"],
}
ALL_TERMS = ["relevant_techniques", "limitations", "future_work", "key_contributions", "datasets_used", "technologies", "evaluation_metrics", "research_domains", "keywords"]


def co_occurrence_clusters(terms: DataFrame, min_size: int = 2, n: int = 20) -> DataFrame:
    """cluster, name, count, percentage, rank: the terms (id, term) of at least so many mentions. The only cluster is "all"."""
    ranked = clustered(terms.select("id", F.lit("all").alias("field"), "term"), n, min_size)
    return ranked.withColumnRenamed("field", "cluster")


def term_landscape(terms: DataFrame, n: int = 20, keywords: int = 30) -> DataFrame:
    """section, name, count, percentage, rank of the whole landscape of records' terms (id, field, term; see landscape.flattened()).

    A section takes the first of its fields that has terms; keywords fall back on the terms of all fields. The section
    "clusters" has co_occurrence_clusters(). Fields are counted once; which have any is a row each.
    """
    ranked = clustered(terms, n)
    every = terms.where(F.col("field").isin(*ALL_TERMS)).withColumn("field", F.lit("_all"))
    merged = clustered(every, keywords).unionByName(co_occurrence_clusters(every, 2, n).withColumnRenamed("cluster", "field").withColumn("field", F.lit("_clusters")))
    wanted = [(s, f, k) for s, fields in SOURCES.items() for k, f in enumerate(fields)] + [("keywords", "_all", 1), ("clusters", "_clusters", 0)]
    table = terms.sparkSession.createDataFrame(wanted, "section string, field string, choice int")
    found = ranked.unionByName(merged).join(F.broadcast(table), "field")  # a fixed table of 16 rows
    chosen = found.groupBy("section").agg(F.min("choice").alias("choice"))
    return found.join(F.broadcast(chosen), ["section", "choice"]).select("section", "name", "count", "percentage", "rank")  # a row for each section
