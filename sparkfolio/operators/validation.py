"""Row quality: rules as Columns, scores and statuses, batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Points that warnings cost, and rules that make a record invalid.
PENALTIES = {"missing_abstract": 10, "missing_venue": 5, "missing_authors": 10, "invalid_year": 5, "invalid_citation_count": 5, "invalid_doi_format": 5, "invalid_url": 5}
CRITICAL = ["duplicate_doi", "duplicate_title", "duplicate_url", "empty_title", "future_year"]
DOI = r"^10\.\d{4,}/[\w.\-;()/:<>]+$"
URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]+"


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def with_issues(papers: DataFrame, as_of_year: int, rules: dict[str, Column] | None = None) -> DataFrame:
    """papers with issues array<string>: the rules that a record breaks, in the order of the rules; rules adds to the standard ones.

    A duplicate is any of several records of the batch with the same DOI, title or URL (lower case, stripped, not blank). Counting
    them is one grouped count a key, joined back: a key is as skewed as the batch's largest crowd of copies, and aggregated first.
    """
    df = papers
    for column in ("doi", "title", "url"):
        key = strip(F.lower(F.col(column)))
        df = df.withColumn(f"_k_{column}", F.when(key != "", key))
        many = df.where(F.col(f"_k_{column}").isNotNull()).groupBy(F.col(f"_k_{column}").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key", F.lit(True).alias(f"_dup_{column}"))
        df = df.join(many, F.col(f"_k_{column}") == F.col("_key"), "left").drop("_key")
    standard = {
        "duplicate_doi": F.col("_dup_doi"),
        "duplicate_title": F.col("_dup_title"),
        "duplicate_url": F.col("_dup_url"),
        "empty_title": blank(F.col("title")),
        "missing_abstract": blank(F.col("abstract")),
        "missing_authors": F.coalesce(F.size("authors"), F.lit(0)) <= 0,
        "missing_venue": blank(F.col("venue")),
        "future_year": F.col("year") > as_of_year,
        "invalid_year": F.col("year") < 1900,
        "invalid_citation_count": F.col("citations") < 0,
        "invalid_doi_format": ~blank(F.col("doi")) & ~strip(F.col("doi")).rlike(DOI),
        "invalid_url": ~blank(F.col("url")) & ~strip(F.col("url")).rlike(URL),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in {**standard, **(rules or {})}.items()]))
    return df.withColumn("issues", found).drop(*[f"_k_{c}" for c in ("doi", "title", "url")], *[f"_dup_{c}" for c in ("doi", "title", "url")])


def scored(df: DataFrame) -> DataFrame:
    """with_issues() with score and status: 100 less the penalties, 0 with a critical rule; 90 valid, 70 warning, else invalid."""
    lost = F.aggregate(F.transform("issues", lambda i: F.coalesce(F.element_at(F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))]), i), F.lit(0))), F.lit(0), lambda a, b: a + b)
    critical = F.arrays_overlap("issues", F.array(*map(F.lit, CRITICAL)))
    score = F.when(critical, 0).otherwise(F.greatest(F.lit(100) - lost, F.lit(0)))
    return df.withColumn("score", score).withColumn("status", F.when(critical, "invalid").when(F.col("score") >= 90, "valid").when(F.col("score") >= 70, "warning").otherwise("invalid"))


def stage_summary(validated: DataFrame, messages: str = "messages") -> DataFrame:
    """summary() as a stage's artifact has it: records count as duplicates if a message has "duplicate" in it, in lower case; so
    messages that begin with "Duplicate" don't count."""
    hit = F.exists(F.coalesce(F.col(messages), F.array().cast("array<string>")), lambda m: F.coalesce(F.contains(m, F.lit("duplicate")), F.lit(False)))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("valid", "warning", "invalid")]
    return validated.agg(F.count("*").alias("total"), *counts, F.count_if(hit).alias("duplicates"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("average_score"))


def summary(validated: DataFrame) -> DataFrame:
    """One row: counts by status, records with a duplicate rule, mean score."""
    duplicate = F.exists("issues", lambda i: i.startswith("duplicate_"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("valid", "warning", "invalid")]
    return validated.agg(F.count("*").alias("total"), *counts, F.count_if(duplicate).alias("duplicates"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("average_score"))
