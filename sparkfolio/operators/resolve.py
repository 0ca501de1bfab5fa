"""Duplicate papers: the same by DOI, external id, title, normalised title or URL; merged, or the first kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_title, normalized_url, strip
from ..shipping import ship


KINDS = ("doi", "title", "norm", "url", "id")


def match_keys(papers: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """pos and keys array<string>: what a paper matches others by, with the kind of each as a prefix."""
    title, doi = strip(F.lower("title")), strip(F.lower("doi"))
    key = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), c))
    made = {"doi": doi, "title": title, "norm": normalized_title(F.col("title"))}
    if "url" in kinds:
        made["url"] = normalized_url(F.col("url"))
    keys = [key(k, c) for k, c in made.items() if k in kinds]
    if "id" in kinds and "external_ids" in papers.columns:
        ids = F.transform("external_ids", lambda e: F.concat(F.lit("id:"), e["namespace"], F.lit(":"), e["id"]))
        return papers.select("pos", F.array_union(F.array_compact(F.array(*keys)), ids).alias("keys"))
    return papers.select("pos", F.array_compact(F.array(*keys)).alias("keys"))


def transitive_groups(papers: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """pos, group: papers connected through any keys, named by their smallest pos. For any size and any length of chain: each paper
    hangs on the first one of each key, then large-star and small-star steps (grouped minima and joins with them) go on until every
    paper hangs on its group's smallest alone; steps grow with the logarithm of the length. Chains of matches join here, unlike in
    greedy_groups()."""
    keyed = match_keys(papers, kinds).select("pos", F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("pos").alias("v"))
    e = keyed.join(first, "key").select(F.col("pos").alias("u"), "v").where("u <> v").distinct().checkpoint()
    while True:
        several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        deep = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.lit(1).cast("long").alias("n")).limit(1)
        if not several.unionByName(deep).head(1):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return papers.select("pos").join(e, F.col("pos") == F.col("u"), "left").select("pos", F.coalesce("v", "pos").alias("group"))


class _FirstWins:
    """The sequential rule over one block's papers in the order of pos: only kept papers' keys count for later ones."""

    def __init__(self) -> None:
        self.owner: dict[str, int] = {}

    def group(self, pos: int, keys: list[str]) -> int:
        hits = [self.owner[k] for k in keys if k in self.owner]
        if not hits:
            for k in keys:
                self.owner.setdefault(k, pos)
        return min(hits, default=pos)


def greedy_groups(papers: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """pos, group: papers in the order of pos, each put to the first kept paper with which it shares a key, else kept itself.

    The sequential rule only matters within connected papers, so blocks are the transitive groups: exact, and parallel. A
    block's positions and keys stream through its task in order; what the task holds is the keys of papers that were kept.
    """
    ship(papers.sparkSession)
    blocks = match_keys(papers, kinds).join(transitive_groups(papers, kinds), "pos")
    alone = blocks.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    several = blocks.join(alone, "group", "left_semi").select("group", "pos", "keys")
    schema = pa.schema([("pos", pa.int64()), ("group", pa.int64())])

    def run(batches):
        block, rule = None, _FirstWins()
        for batch in batches:
            groups = []
            for g, pos, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != block:
                    block, rule = g, _FirstWins()
                groups.append(rule.group(pos, keys))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(groups, pa.int64())], schema=schema)

    grouped = several.repartition("group").sortWithinPartitions("group", "pos").mapInArrow(run, "pos long, group long")
    return grouped.unionByName(blocks.join(alone, "group", "left_anti").select("pos", "group"))


def kept_first(papers: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The papers that greedy_groups() keeps; by ("doi", "title", "norm") the plain list without repeated papers."""
    return papers.join(greedy_groups(papers, kinds).where("pos = group").select("pos"), "pos", "left_semi")


def merged(papers: DataFrame) -> DataFrame:
    """A row per group: each field's first value that is there in the order of pos, the longest author list, and where it came from."""
    with_group = papers.join(greedy_groups(papers), "pos")
    there = lambda c: F.when(F.col(c).cast("string") != "", F.struct("pos", F.col(c).alias("v")))
    fields = [F.min(there(c))["v"].alias(c) for c in ("title", "abstract", "doi", "url", "venue", "year", "citations")]
    longest = F.max_by("authors", F.struct(F.size("authors"), -F.col("pos")))
    return with_group.groupBy("group").agg(*fields, longest.alias("authors"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("merged_from"), F.count("*").alias("copies"))


def provenance(papers: DataFrame, groups: DataFrame) -> DataFrame:
    """group, field, providers: who gave a value for a field, in the order of pos."""
    fields = ["title", "abstract", "doi", "url", "venue", "year", "citations"]
    long = papers.join(groups, "pos").select("group", "pos", "source", F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in fields])).alias("field")).where("field is not null")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"])
    return long.groupBy("group", "field").agg(F.array_join(F.array_distinct(ordered), ",").alias("providers"))


def single_key(papers: DataFrame, key) -> DataFrame:
    """The first paper for each value of a key (a Column); papers without one stay."""
    k = F.coalesce(key, F.concat(F.lit("pos:"), F.col("pos").cast("string")))
    return papers.withColumn("_n", F.row_number().over(Window.partitionBy(k).orderBy("pos"))).where("_n = 1").drop("_n")
