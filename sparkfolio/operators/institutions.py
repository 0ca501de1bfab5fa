"""Profiles, rankings, search, filters and comparison of institutions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import INSTITUTION_KINDS, kind_of
from ..session import stored
from . import graph


def ranking_entries(papers: DataFrame, institutions: DataFrame, authors: DataFrame, technologies: DataFrame, domains: DataFrame) -> DataFrame:
    """institution, paper_count, author_count, citation_count, avg_citations, growth_rate, technology_count, domain_count, collaboration_score

    Each measure is an aggregate of its own over a pruned bridge, joined by institution: none multiplies another's rows.
    """
    inst = institutions.select("paper_id", F.col("name").alias("institution"))
    cited = inst.join(papers.select("paper_id", "citations", "year"), "paper_id")
    base = cited.groupBy("institution").agg(F.count("*").alias("paper_count"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citation_count"))
    base = base.withColumn("avg_citations", F.round(F.col("citation_count") / F.greatest("paper_count", F.lit(1)), 2))
    years = cited.where("year is not null").groupBy("institution", "year").agg(F.count("*").alias("papers"))
    rate = graph.growth(years, ["institution"], floor_previous=True).select("institution", F.round("growth", 4).alias("growth_rate"))
    out = base.join(rate, "institution", "left")
    for label, bridge in (("author_count", authors), ("technology_count", technologies), ("domain_count", domains)):
        n = inst.join(bridge, "paper_id").select("institution", "name").distinct().groupBy("institution").agg(F.count("*").alias(label))
        out = out.join(n, "institution", "left").withColumn(label, F.coalesce(label, F.lit(0)))
    degrees = graph.weighted_degrees(graph.pair_counts(institutions)).select(F.col("name").alias("institution"), F.round("centrality", 4).alias("collaboration_score"))
    return out.join(degrees, "institution", "left").withColumns({"collaboration_score": F.coalesce("collaboration_score", F.lit(0.0)), "growth_rate": F.coalesce("growth_rate", F.lit(0.0))})


def entries_of_sets(papers: DataFrame, sets: DataFrame) -> DataFrame:
    """ranking_entries() from a row a paper with arrays of distinct names (institution, author, technology, domain; sorted).

    Papers are dealt once; measures by institution are three aggregates of what follows from a row: papers and citations by
    year, distinct names of the other kinds, and pairs of institutions.
    """
    rows = sets.join(papers.select("paper_id", "citations", "year"), "paper_id")
    each = rows.select(F.explode("institution").alias("institution"), "citations", "year", "author", "technology", "domain")
    years = each.groupBy("institution", "year").agg(F.count("*").alias("papers"), F.sum("citations").alias("cited"))
    base = years.groupBy("institution").agg(F.sum("papers").alias("paper_count"), F.coalesce(F.sum("cited"), F.lit(0)).alias("citation_count"))
    base = base.withColumn("avg_citations", F.round(F.col("citation_count") / F.greatest("paper_count", F.lit(1)), 2))
    rate = graph.growth(years.where("year is not null").select("institution", "year", "papers"), ["institution"], floor_previous=True).select("institution", F.round("growth", 4).alias("growth_rate"))
    tagged = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    named = F.flatten(F.array(*map(tagged, ("author", "technology", "domain"))))
    names = each.select("institution", F.explode(named).alias("e")).select("institution", "e.kind", "e.name").distinct()
    counts = names.groupBy("institution").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("author", "technology", "domain")])
    pairs = graph.set_pair_counts(sets.select(F.col("institution").alias("names")))
    degrees = graph.weighted_degrees(pairs).select(F.col("name").alias("institution"), F.round("centrality", 4).alias("collaboration_score"))
    out = base.join(rate, "institution", "left").join(counts, "institution", "left").join(degrees, "institution", "left")
    zero = {"collaboration_score": 0.0, "growth_rate": 0.0, "author_count": 0, "technology_count": 0, "domain_count": 0}
    return out.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in zero.items()})


#: Criterion -> column; anything else ranks by papers. Fixed values.
CRITERIA = {"publication_count": "paper_count", "citation_count": "citation_count", "avg_citations": "avg_citations", "growth_rate": "growth_rate", "technology_diversity": "technology_count", "research_diversity": "domain_count", "collaboration_score": "collaboration_score"}
#: List -> (column that it is sorted by, least value that it asks for, itself left out). Fixed values.
INTELLIGENCE = {
    "top_institutions": ("paper_count", None), "emerging_institutions": ("growth_rate", 0.3), "most_collaborative": ("collaboration_score", None), "fastest_growing": ("growth_rate", None),
    "technology_leaders": ("technology_count", None), "dataset_leaders": ("paper_count", None), "methodology_leaders": ("domain_count", None),
}


def ranked(entries: DataFrame, criterion: str, limit: int) -> DataFrame:
    """The first entries by a criterion, numbered from 1; ties by name."""
    column = CRITERIA.get(criterion, "paper_count")
    top = entries.orderBy(F.desc(column), "institution").limit(limit)
    return graph.top_n(top.withColumn("_one", F.lit(1)), limit, ["_one"], [F.desc(column), F.col("institution")]).drop("_one")


def leaders(entries: DataFrame, limit: int = 10) -> DataFrame:
    """list, institution, value, rank: the seven lists of INTELLIGENCE, ties by name; one pass over the entries for all of them."""
    lists = [F.when(F.lit(True) if least is None else F.col(c) > least, F.struct(F.lit(k).alias("list"), F.col(c).cast("double").alias("value"))) for k, (c, least) in INTELLIGENCE.items()]
    each = entries.select("institution", F.explode(F.array_compact(F.array(*lists))).alias("e")).select("institution", "e.*")
    return graph.top_n(each, limit, ["list"], [F.desc("value"), F.col("institution")]).select("list", "institution", "value", "rank")


STOP = ["of", "the", "and", "for", "in", "at", "on", "by", "a", "an"]


def name_score(name: Column, query: str) -> Column:
    """How well a name answers a query: equal 1, prefix 0.9, initials 0.85, substring (of three or more) 0.7, shared words 0.4 times their share."""
    q, n = query.strip().lower(), F.lower(name)
    words = F.filter(F.split(n, r"\s+"), lambda w: w != "")
    initials = F.array_join(F.transform(F.filter(words, lambda w: ~w.isin(*STOP)), lambda w: F.substring(w, 1, 1)), "")
    asked = q.split()
    named = lambda t: F.exists(words, lambda w: F.contains(w, F.lit(t))).cast("int")
    hits = sum(map(named, asked), F.lit(0))
    score = F.when(n == q, 1.0).when(n.startswith(q), 0.9)
    if len(q) >= 2:
        score = score.when((F.size(words) >= 2) & (initials == q), 0.85)
    if len(q) >= 3:
        score = score.when(F.contains(n, F.lit(q)), 0.7)
    if len(q) >= 2:
        score = score.when(hits > 0, 0.4 * hits / max(len(asked), 1))
    return score.otherwise(0.0)


def fuzzy_score(name: Column, query: str) -> Column:
    """The last resort of a search: 0.3 times a sequence ratio above 0.6, which SQL has no function for (a pandas UDF, over distinct names)."""

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        r = names.map(lambda x: SequenceMatcher(None, (x or "").lower(), query.strip().lower()).ratio())
        return r.where(r > 0.6, 0.0) * 0.3

    return ratio(name)


def search(entries: DataFrame, query: str, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """institution, paper_count, relevance_score of the best names; ties by papers, then name. Blank queries find nothing.

    Names that score nothing otherwise may be similar as sequences, unless fuzzy is off."""
    if not query.strip():
        return entries.select("institution", "paper_count", F.lit(0.0).alias("relevance_score")).limit(0)
    exact = name_score(F.col("institution"), query)
    score = F.when(exact > 0, exact).otherwise(fuzzy_score(F.col("institution"), query)) if fuzzy else exact
    found = entries.withColumn("relevance_score", F.round(score, 4)).where("relevance_score > 0")
    return found.orderBy(F.desc("relevance_score"), F.desc("paper_count"), "institution").limit(limit).select("institution", "paper_count", "relevance_score")


def topic_papers(bridges: list[DataFrame], topic: str) -> DataFrame:
    """paper_id, once, of papers one of whose names contains the topic."""
    q = topic.strip().lower()
    out = None
    for b in bridges:
        hit = b.where(F.contains(F.lower("name"), F.lit(q))).select("paper_id")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def topic_search(topic: DataFrame, institutions: DataFrame, papers: DataFrame, limit: int) -> DataFrame:
    """institution, papers, citations, relevance (share of the topic's papers)"""
    inst = institutions.join(topic, "paper_id", "left_semi").join(papers.select("paper_id", "citations"), "paper_id")
    counts = inst.groupBy(F.col("name").alias("institution")).agg(F.count("*").alias("papers"), F.sum("citations").alias("citations"))
    total = topic.agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(total)).withColumn("relevance", F.round(F.col("papers") / F.col("_n"), 4)).drop("_n").orderBy(F.desc("papers"), F.desc("citations"), "institution").limit(limit)  # one row


def topic_details(found: DataFrame, topic: DataFrame, institutions: DataFrame, papers: DataFrame, authors: DataFrame, n: int = 5) -> DataFrame:
    """institution, kind (paper or author), name, value, rank: of each institution of topic_search(), the topic's most cited papers (value:
    citations) and the authors with most of them (value: papers)."""
    own = institutions.select("paper_id", F.col("name").alias("institution")).join(F.broadcast(found.select("institution")), "institution").join(topic, "paper_id", "left_semi")  # a row for each of a limited list
    cited = own.join(papers.select("paper_id", "citations"), "paper_id").select("institution", F.lit("paper").alias("kind"), F.col("paper_id").alias("_id"), F.col("paper_id").cast("string").alias("name"), F.coalesce("citations", F.lit(0)).cast("long").alias("value"))
    wrote = own.join(authors.select("paper_id", "name"), "paper_id").groupBy("institution", "name").agg(F.count("*").alias("value"))
    both = cited.unionByName(wrote.select("institution", F.lit("author").alias("kind"), F.lit(None).cast("long").alias("_id"), "name", "value"))
    return graph.top_n(both, n, ["institution", "kind"], [F.desc("value"), F.col("_id"), F.col("name")]).drop("_id")


def filtered(institutions: DataFrame, papers: DataFrame, bridges: dict[str, DataFrame], min_papers: int = 0, min_citations: int = 0, years: tuple[int | None, int | None] = (None, None), containing: dict[str, list[str]] | None = None) -> DataFrame:
    """institution, paper_count, citation_count of those with enough of both over all papers and one paper that meets the rest.

    containing: kind of bridge -> substrings, any of which a name must contain (in lower case).
    """
    cited = institutions.join(papers.select("paper_id", "citations", "year"), "paper_id")
    totals = cited.groupBy(F.col("name").alias("institution")).agg(F.count("*").alias("paper_count"), F.sum("citations").alias("citation_count"))
    totals = totals.where((F.col("paper_count") >= max(1, min_papers)) & (F.col("citation_count") >= min_citations))
    fit = cited.select(F.col("name").alias("institution"), "paper_id", "year")
    if years[0] is not None:
        fit = fit.where(F.col("year") >= years[0])
    if years[1] is not None:
        fit = fit.where(F.col("year") <= years[1])
    for kind, words in (containing or {}).items():
        hit = bridges[kind].where(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower("name"), w)))
        fit = fit.join(hit.select("paper_id"), "paper_id", "left_semi")
    return totals.join(fit, "institution", "left_semi")


#: Label, column, and what the value must be above (strengths) or below (weaknesses). Fixed values.
STRENGTHS = [
    ("High publication output", "paper_count", 10), ("High citation impact", "citation_count", 100), ("High average citations per paper", "avg_citations", 10),
    ("Fast publication growth", "growth_rate", 0.5), ("Broad research diversity", "diversity", 0.3), ("Strong collaboration network", "collaboration_score", 0.5),
]
WEAKNESSES = [
    ("Low publication output", "paper_count", 3), ("Low citation impact", "citation_count", 10), ("Below-average citations per paper", "avg_citations", 3),
    ("Declining publication trend", "growth_rate", 0), ("Narrow research focus", "diversity", 0.1), ("Limited collaboration network", "collaboration_score", 0.1),
]


def compare(entries: DataFrame, names: list[str]) -> DataFrame:
    """Two to five institutions side by side with diversity (domains a paper), strengths and weaknesses, joined by "; "."""
    e = entries.where(F.col("institution").isin(*names)).withColumn("diversity", F.round(F.col("domain_count") / F.greatest("paper_count", F.lit(1)), 4))
    label = lambda cases, holds: F.array_join(F.array_compact(F.array(*[F.when(holds(F.col(c), x), t) for t, c, x in cases])), "; ")
    return e.withColumns({"strengths": label(STRENGTHS, lambda c, x: c > x), "weaknesses": label(WEAKNESSES, lambda c, x: c < x)})


def details(papers: DataFrame, sets: DataFrame, home: DataFrame, n: int = 10) -> DataFrame:
    """institution, section, name, value, rank: whole profiles of all institutions.

    sets: a row a paper with arrays of distinct names (institution, author, technology, domain, dataset, methodology); home: author
    name and institution, distinct. Sections: total (papers, authors, citations); domain, technology, dataset, methodology and year
    (all of them, by papers; years in order); author, co_author (of papers, but not at home here), collaborator (n each) and paper
    (n, by citations). Papers are dealt once, and one count over (institution, section, name) serves all but papers and totals: both
    are written, as each reader would make them anew for the sections that it asks for.
    """
    dealt = stored(sets.join(papers.select("paper_id", "citations", "year"), "paper_id"))
    rows = dealt.select("*", F.explode("institution").alias("own"))
    tagged = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("section"), x.cast("string").alias("name")))
    year = F.when(F.col("year").isNotNull(), F.array("year")).otherwise(F.array().cast("array<int>"))
    partners = F.filter("institution", lambda x: x != F.col("own"))
    kinds = {"author": F.col("author"), "domain": F.col("domain"), "technology": F.col("technology"), "dataset": F.col("dataset"), "methodology": F.col("methodology"), "collaborator": partners, "year": year}
    names = F.flatten(F.array(*[tagged(k, c) for k, c in kinds.items()]))
    counts = stored(rows.select(F.col("own").alias("institution"), F.explode(names).alias("e")).groupBy("institution", "e.section", "e.name").agg(F.count("*").alias("value")))
    foreign = counts.where("section = 'author'").join(home.select("institution", F.col("author").alias("name")), ["institution", "name"], "left_anti").withColumn("section", F.lit("co_author"))
    of = lambda section: F.when(section == "year", F.col("name"))
    by = [of(F.col("section")), F.desc("value"), F.col("name")]
    w = Window.partitionBy("institution", "section").orderBy(*by)
    whole = counts.where(~F.col("section").isin("author", "collaborator")).withColumn("rank", F.row_number().over(w).cast("long"))
    first = graph.top_n(counts.where(F.col("section").isin("author", "collaborator")).unionByName(foreign.select(*counts.columns)), n, ["institution", "section"], [F.desc("value"), F.col("name")])
    cited = rows.select(F.col("own").alias("institution"), F.lit("paper").alias("section"), "paper_id", F.coalesce("citations", F.lit(0)).cast("long").alias("value"))
    cited = graph.top_n(cited, n, ["institution"], [F.desc("value"), F.col("paper_id")]).select("institution", "section", F.col("paper_id").cast("string").alias("name"), "value", "rank")
    sums = rows.groupBy(F.col("own").alias("institution")).agg(F.count("*").alias("papers"), F.coalesce(F.sum("citations"), F.lit(0)).cast("long").alias("citations"))
    sums = sums.join(counts.where("section = 'author'").groupBy("institution").agg(F.count("*").alias("authors")), "institution", "left")
    totals = sums.select("institution", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(k, F.lit(0)).cast("long").alias("value")) for k in ("papers", "authors", "citations")])).alias("e"))
    totals = totals.select("institution", F.lit("total").alias("section"), "e.*", F.lit(None).cast("long").alias("rank"))
    return whole.unionByName(first).unionByName(cited).unionByName(totals)


def by_type(institutions: DataFrame, n: int = 10) -> DataFrame:
    """kind, institution, papers, rank: the first n institutions of each type."""
    counts = institutions.groupBy(F.col("name").alias("institution")).agg(F.count("*").alias("papers")).withColumn("kind", kind_of(F.col("institution"), INSTITUTION_KINDS))
    return graph.top_n(counts, n, ["kind"], [F.desc("papers"), F.col("institution")])


def profile_lists(institutions: DataFrame, bridges: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """institution, kind, name, papers, rank: the first n names of each kind at each institution."""
    inst = institutions.select("paper_id", F.col("name").alias("institution"))
    out = None
    for kind, bridge in bridges.items():
        part = inst.join(bridge, "paper_id").groupBy("institution", "name").agg(F.count("*").alias("papers")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return graph.top_n(out, n, ["institution", "kind"], [F.desc("papers"), F.col("name")])


def external_coauthors(institutions: DataFrame, authors: DataFrame, home: DataFrame) -> DataFrame:
    """institution, external: authors on its papers who don't belong to it. home: author name and institution, distinct."""
    inst = institutions.select("paper_id", F.col("name").alias("institution"))
    on_papers = inst.join(authors.select("paper_id", F.col("name").alias("author")), "paper_id").select("institution", "author").distinct()
    return on_papers.join(home, ["institution", "author"], "left_anti").groupBy("institution").agg(F.count("*").alias("external"))
