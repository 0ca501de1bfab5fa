"""Writes as DataFrame transformations: upserts, idempotent inserts, deletes, artifacts, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_existing(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new with paper_id and matched_by: the stored paper (id, doi, title) of the same DOI, else of the same title, else its own pos.

    Two equi-joins on unique keys rather than one with OR, which would be a nested loop.
    """
    by_doi = stored.where(F.col("doi") != "").groupBy(F.lower("doi").alias("_doi")).agg(F.min("id").alias("_by_doi"))
    by_title = stored.where(F.col("title") != "").groupBy(F.col("title").alias("_title")).agg(F.min("id").alias("_by_title"))
    joined = new.join(by_doi, F.lower("doi") == F.col("_doi"), "left").join(by_title, F.col("title") == F.col("_title"), "left")
    how = F.when(F.col("_by_doi").isNotNull(), "doi").when(F.col("_by_title").isNotNull(), "title").otherwise("new")
    return joined.withColumns({"paper_id": F.coalesce("_by_doi", "_by_title", "pos"), "matched_by": how}).drop("_doi", "_by_doi", "_title", "_by_title")


def only_new(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't stored, once each: what an insert-if-absent appends."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with new's rows put in place of those of the same key. Keys must be unique on either side."""
    rest = [c for c in stored.columns if c not in keys]
    right = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_there"))
    joined = stored.join(right, keys, "full")
    return joined.select(*keys, *[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def without(rows: DataFrame, predicate: Column) -> DataFrame:
    """rows after a delete: those for which the predicate is false or unknown."""
    return rows.where(~F.coalesce(predicate, F.lit(False)))


def artifact(payload: DataFrame, artifact_type: str, investigation: str = "investigation_id", version: int = 1) -> DataFrame:
    """A JSON document a row: investigation_id, artifact_type, version, status, payload (the other columns)."""
    rest = [c for c in payload.columns if c != investigation]
    return payload.select(F.col(investigation).alias("investigation_id"), F.lit(artifact_type).alias("artifact_type"), F.lit(version).alias("version"), F.lit("ready").alias("status"), F.to_json(F.struct(*rest)).alias("payload"))


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Appends artifacts to a folder partitioned by type, so that readers of a type scan only its files."""
    artifacts.write.mode("append").partitionBy("artifact_type").parquet(path)


def latest_ready(artifacts: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the newest artifact that is ready and has a payload (ties: the larger id)."""
    ready = artifacts.where((F.col("status") == "ready") & (F.coalesce("payload", F.lit("")) != ""))
    last = F.max_by(F.struct("id", "payload", "created_at"), F.struct("created_at", "id")).alias("_a")
    return ready.groupBy(*by).agg(last).select(*by, "_a.*")


def stored_chunks(chunks: DataFrame, embeddings: DataFrame, version: int) -> DataFrame:
    """chunks with their embeddings (both by chunk_index) and a version; nothing if one of the chunks has no embedding or the other way round."""
    both = chunks.join(embeddings, "chunk_index", "full")
    gap = both.where(F.col("content").isNull() | F.col("embedding").isNull()).limit(1).select(F.lit(1).alias("_gap"))
    return both.join(F.broadcast(gap), F.lit(True), "left_anti").withColumn("artifact_version", F.lit(version))


def latest_of_format(artifacts: DataFrame, artifact_type: str, form: str) -> DataFrame:
    """One row at most: payload of the newest artifact of a type whose payload's format is the one asked for."""
    fits = artifacts.where((F.col("artifact_type") == artifact_type) & (F.get_json_object("payload", "$.format") == form))
    return fits.orderBy(F.desc("created_at"), F.desc("id")).limit(1)
