"""Connected components of a graph given as a DataFrame of edges, without collecting any of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, ship


def locally_contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars around the smallest node of what they connect: the same components, fewer and flatter edges."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], schema=schema)

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, v for edges (u, v: long, never null): every node that isn't the smallest of its component, with the smallest.

    Alternates large-star and small-star steps (each a grouped minimum and a join with it) on edges that partitions have
    contracted, until every node hangs on a root; steps grow with the logarithm of the size. Each step is written to the
    shared folder. Loops and repeated edges change nothing.
    """
    ship(edges.sparkSession)
    e = cut(locally_contracted(edges.where("u <> v")).distinct())
    while True:
        parents = e.select(F.col("v").alias("u")).distinct()
        several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        deep = e.join(parents, "u", "left_semi").select("u", F.lit(1).cast("long").alias("n")).limit(1)
        if not several.unionByName(deep).head(1):
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
