"""The life of stored embeddings: versions, stale chunks, what has to be embedded anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped
from ..session import stored as written
from .retrieval import chunked, embed
from .tables import Table, Version


def embedded_counts(investigations: DataFrame, stored: DataFrame) -> DataFrame:
    """investigation_id, chunks, max_version of what is stored (investigation_id, artifact_version); 0 and 0 without any."""
    counts = stored.groupBy("investigation_id").agg(F.count("*").alias("chunks"), F.max("artifact_version").alias("max_version"))
    out = investigations.select("investigation_id").distinct().join(counts, "investigation_id", "left")
    return out.select("investigation_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("max_version", F.lit(0)).cast("long").alias("max_version"))


def to_refresh(artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """artifacts (id, investigation_id, version, status, payload) that are ready and newer than all that is stored of their
    investigation, with next_version: the one after it. An artifact without a version is always refreshed."""
    top = stored.groupBy("investigation_id").agg(F.max("artifact_version").alias("_max"))
    joined = artifacts.where("status = 'ready'").join(top, "investigation_id", "left").withColumn("_max", F.coalesce("_max", F.lit(0)).cast("long"))
    fresh = (F.coalesce("version", F.lit(0)) == 0) | (F.col("version") > F.col("_max"))
    return joined.where(fresh).withColumn("next_version", F.col("_max") + 1).drop("_max")


def refreshed(artifacts: DataFrame, stored: DataFrame, embedder=None, dimensions: int = 384) -> DataFrame:
    """stored (investigation_id, artifact_id, chunk_index, content, embedding, artifact_version) after a run: artifacts to refresh
    lose their chunks and get new ones at the next version; everything else stays."""
    todo = to_refresh(artifacts, stored)
    left = stored.join(todo.select("investigation_id", F.col("id").alias("artifact_id")), ["investigation_id", "artifact_id"], "left_anti")
    return left.unionByName(_embedded(todo, embedder, dimensions).select(*left.columns))


def refreshed_table(artifacts: DataFrame, table: Table, embedder=None, dimensions: int = 384) -> Version:
    """refreshed() on a stored table (its buckets by investigation_id): only buckets of the artifacts' investigations are read, only
    those with something to refresh written."""
    base = table.version()
    here = table.found(artifacts.select("investigation_id").distinct(), base)
    todo = written(to_refresh(artifacts, here))
    new = written(_embedded(todo, embedder, dimensions))
    try:
        return table.change(todo.select("investigation_id", F.col("id").alias("artifact_id")), new, base)
    finally:
        dropped(todo, new)


def _embedded(todo: DataFrame, embedder, dimensions: int) -> DataFrame:
    of = F.struct("investigation_id", F.col("id").alias("artifact_id"), F.col("next_version").alias("artifact_version"))
    pieces = chunked(todo.select(of.alias("_of"), "payload"), "_of", "payload")
    return embed(pieces, "content", dimensions, embedder).select("_of.*", "chunk_index", "content", "embedding")


def summary(artifacts: DataFrame, stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """investigation_id, artifacts_processed, artifacts_skipped, chunks_created of a run that made chunks (as refreshed() gives them)."""
    ready = artifacts.where("status = 'ready'").groupBy("investigation_id").agg(F.count("*").alias("_all"))
    done = to_refresh(artifacts, stored).groupBy("investigation_id", "next_version").agg(F.count("*").alias("_done"))
    made = chunks.groupBy("investigation_id", F.col("artifact_version").alias("next_version")).agg(F.count("*").alias("_n"))
    joined = ready.join(done, "investigation_id", "left").join(made, ["investigation_id", "next_version"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("investigation_id", zero("_done").alias("artifacts_processed"), (F.col("_all") - zero("_done")).alias("artifacts_skipped"), zero("_n").alias("chunks_created"))
