"""Landscapes of research: exploded terms of records, clustered, counted and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_term
from .graph import top_n


def flattened(records: DataFrame, id_column: str, fields: dict[str, Column]) -> DataFrame:
    """id, field, term: a row for each item of each field (arrays or scalars); null and empty items are left out."""
    as_array = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    structs = [_tagged(as_array(c), name) for name, c in fields.items()]
    return records.select(F.col(id_column).alias("id"), F.explode(F.concat(*structs)).alias("x")).select("id", "x.field", "x.term").where(F.coalesce("term", F.lit("")) != "")


def _tagged(items: Column, name: str) -> Column:
    return F.transform(items, lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))


def clustered(terms: DataFrame, n: int = 20, min_count: int = 1) -> DataFrame:
    """field, name, count, percentage, rank: normalised terms of a field by count (ties by name); percentages of all its terms, one decimal."""
    clean = terms.withColumn("name", normalized_term(F.col("term"))).where("trim(term) <> ''")
    counts = clean.groupBy("field", "name").agg(F.count("*").alias("count"))
    totals = counts.groupBy("field").agg(F.sum("count").alias("_all"))
    shared = counts.join(F.broadcast(totals), "field").withColumn("percentage", F.round(100 * F.col("count") / F.col("_all"), 1)).drop("_all")  # a row for each field
    return top_n(shared.where(F.col("count") >= min_count), n, ["field"], [F.desc("count"), F.col("name")])


def distribution(df: DataFrame, column: str, lower: bool = False) -> DataFrame:
    """value, count of non-empty values, in lower case and stripped if asked for."""
    value = F.trim(F.lower(column)) if lower else F.col(column).cast("string")
    return df.select(value.alias("value")).where(F.coalesce("value", F.lit("")) != "").groupBy("value").agg(F.count("*").alias("count"))


def statistics(df: DataFrame, column: str) -> DataFrame:
    """total, average, median, max, min, with_data of a column; zeros without values."""
    c = F.col(column)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return df.agg(
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total"), F.round(zero(F.avg(c)), 2).alias("average"), zero(F.median(c)).alias("median"),
        F.coalesce(F.max(c), F.lit(0)).alias("max"), F.coalesce(F.min(c), F.lit(0)).alias("min"), F.count(c).alias("with_data"),
    )


def observations(ranked: DataFrame, most: dict[str, str]) -> DataFrame:
    """field, observation: the first of each field in a sentence; most: field -> format of (name, count)."""
    first = ranked.where("rank = 1")
    text = None
    for field, form in most.items():
        made = F.format_string(form, F.col("name"), F.col("count"))
        text = F.when(F.col("field") == field, made) if text is None else text.when(F.col("field") == field, made)
    return first.select("field", text.alias("observation")).where("observation is not null")


def scaled(df: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """df with value over the largest value (at least 1): bars of a chart."""
    most = df.agg(F.greatest(F.max(value), F.lit(1)).alias("_m"))
    return df.crossJoin(F.broadcast(most)).withColumn(out, F.round(F.col(value) / F.col("_m"), 4)).drop("_m")  # one row
