"""Inverted indexes of texts: a row makes its own, and ids may repeat."""

from pyspark.sql import functions as F

from sparkfolio.functions import text

from .conftest import rows


def test_index_of_each_row(spark):
    texts = ["a b\ta", None, " \n\t", "c", "b\n\nb", "nbsp\u00a0stays \x0b"]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "id long, text string")
    got = text.inverted_index(df, "id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    back = got.select("id", text.abstract_from_index(F.col("index")).alias("t"))
    assert rows(back) == [(0, "a b a"), (1, "c"), (2, "b b"), (2, "nbsp\u00a0stays")]
    same = spark.createDataFrame([(1, {"x": [0, 2], "y": [2, 4]}), (2, {"x": []}), (3, {})], "id long, index map<string, array<int>>")
    assert rows(same.select("id", text.abstract_from_index(F.col("index")))) == [(1, "x  y  y"), (2, None), (3, None)]


def test_repeated_ids_are_rows_each(spark, tmp_path):
    from sparkfolio.plans import registry

    spark.createDataFrame([(1, "a b"), (1, "c d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.QUERIES["fn_abstract_index"](spark, str(tmp_path)).count() == 2
