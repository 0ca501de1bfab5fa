"""Unicode normal forms, which SQL has no function for: Arrow batches over the strings that need them."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship


def bare(text: str | None) -> str | None:
    """text in NFKD without combining marks."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))


def strip_accents(c: Column) -> Column:
    """Plain ASCII passes by; only other strings go through Python."""
    ship()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(bare)

    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(run(c))


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(run(c))
