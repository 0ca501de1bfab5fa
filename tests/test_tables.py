"""Stored tables: what a change rewrites, versions, changes that fail, changes that meet."""

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators.embeddings import refreshed, refreshed_table
from sparkfolio.operators.tables import Outdated, Table

from .conftest import rows


@pytest.fixture
def table(spark, tmp_path):
    first = spark.range(1000).select("id", F.lit("unread").alias("status"), (F.col("id") % 7).alias("n"))
    return Table.made(first, str(tmp_path / "t"), ["id"], buckets=16)


def moved(before, after):
    return {b for b in before.folders.keys() | after.folders.keys() if before.folders.get(b) != after.folders.get(b)}


def test_a_change_rewrites_the_buckets_of_its_keys(spark, table):
    first = table.version()
    assert first.number == 1 and len(first.folders) == 16
    new = spark.createDataFrame([(5, "reading", 1), (5000, "read", None)], "id long, status string, n long")
    second = table.upsert(new)
    assert second.number == 2 and 1 <= len(moved(first, second)) <= 2
    assert rows(table.rows().where("id in (5, 5000)")) == [(5, "reading", 1), (5000, "read", None)]
    assert table.rows().count() == 1001
    assert rows(table.rows(first).where("id = 5")) == [(5, "unread", 5)]  # older versions stay readable
    assert table.upsert(new) == second  # nothing changes, so there is no new version
    assert rows(Table(spark, table.path).found(spark.createDataFrame([(5,), (-1,)], "id long"))) == [(5, "reading", 1)]


def test_insert_if_absent_and_delete(spark, table):
    third = table.upsert(spark.createDataFrame([(5, "reading", 1), (None, "lost", 0)], "id long, status string, n long"), keep=True)
    assert rows(table.rows().where("id = 5 or id is null")) == [(5, "unread", 5), (None, "lost", 0)]
    fourth = table.delete(F.col("id").isin(3, 4) | (F.col("id") > 5000))
    assert len(moved(third, fourth)) <= 2 and table.rows().count() == 999
    assert table.delete(F.col("id") < 0) == fourth
    table.delete(F.lit(True))
    assert rows(table.rows()) == []


def test_repeated_keys_and_failed_changes_leave_the_table(spark, table):
    first = table.version()
    with pytest.raises(ValueError, match="repeat"):
        table.upsert(spark.createDataFrame([(5, "a", 1), (5, "b", 1)], "id long, status string, n long"))
    broken = spark.range(3).select("id", F.raise_error(F.lit("torn")).cast("string").alias("status"), F.lit(1).cast("long").alias("n"))
    with pytest.raises(Exception, match="torn"):
        table.change(spark.range(3).select("id"), broken)
    assert table.version() == first and table.rows().count() == 1000


def test_of_two_changes_from_one_version_the_second_fails(spark, table):
    base = table.version()
    one = spark.createDataFrame([(1, "x", 1)], "id long, status string, n long")
    table.change(one.select("id"), one, base)
    with pytest.raises(Outdated):
        table.change(one.select("id"), one.withColumn("status", F.lit("y")), base)
    assert rows(table.found(one.select("id"))) == [(1, "x", 1)]


def test_cleaned(spark, table):
    for k in range(3):
        table.upsert(spark.createDataFrame([(k, "x", 1)], "id long, status string, n long"))
    before = rows(table.rows())
    table.cleaned(2)
    assert rows(table.rows()) == before and table.version().number == 4 and table.rows(table.version(3)).count() == 1000
    with pytest.raises(Exception):
        table.version(2)


def test_no_rows_at_first(spark, tmp_path):
    table = Table.made(spark.createDataFrame([], "a string, b long"), str(tmp_path / "t"), ["a", "b"], ["a"], 4)
    assert rows(table.rows()) == []
    assert table.upsert(spark.createDataFrame([], "a string, b long")).number == 1
    table.upsert(spark.createDataFrame([("x", 1), ("x", 2), (None, 1)], "a string, b long"))
    table.change(spark.createDataFrame([("x",)], "a string"))
    assert rows(table.rows()) == [(None, 1)]
    with pytest.raises(Exception):
        Table.made(table.rows(), table.path, ["a"])


def test_embeddings_rewrite_their_investigations_only(spark, tmp_path):
    vector = F.array(F.lit(0.5).cast("double"))
    old = spark.range(40).select(F.col("id").alias("investigation_id"), (F.col("id") * 10).alias("artifact_id"), F.lit(0).alias("chunk_index"), F.lit("old").alias("content"), vector.alias("embedding"), F.lit(1).cast("long").alias("artifact_version"))
    artifacts = spark.createDataFrame([(10, 1, 2, "ready", "newer text"), (20, 2, 1, "ready", "known"), (990, 99, 1, "ready", "first")], "id long, investigation_id long, version long, status string, payload string")
    want = rows(refreshed(artifacts, old, dimensions=4).select("investigation_id", "artifact_id", "chunk_index", "content", "artifact_version"))
    table = Table.made(old, str(tmp_path / "t"), ["investigation_id", "artifact_id", "chunk_index"], ["investigation_id"], 32)
    first = table.version()
    second = refreshed_table(artifacts, table, dimensions=4)
    assert rows(table.rows().select("investigation_id", "artifact_id", "chunk_index", "content", "artifact_version")) == want
    assert 1 <= len(moved(first, second)) <= 2
    assert refreshed_table(artifacts.where("version = 0"), table, dimensions=4) == second
