"""Whitening of embeddings: a distributed singular value decomposition of centred rows."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import ship

#: A component's value is floor(SCALE * it) + SHIFT, a whole number, so that sums over any number of rows in any order are exact.
SCALE, SHIFT = 64, 1_000_000
#: Components whose singular value is below this share of the largest are noise of the arithmetic and are left out.
LEAST_SHARE = 1e-6
#: Entries from this size on have no place among exact sums of whole numbers.
TOO_LARGE = 2.0**46


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, v array<double>: rows whose vector is there, with neither null nor non-finite entries nor any of TOO_LARGE or more."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    return embeddings.where(v.isNotNull() & (F.size(v) > 0) & finite).select(F.col("vec_id"), v.alias("v"))


def whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The whole-number vectors of a batch, a row each."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def sums_of(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; a task sends one row, its d sums."""

    def run(batches):
        n, total = 0, np.zeros(d, dtype=object)
        for b in batches:
            if b.num_rows:
                n += b.num_rows
                total += whole(b, d).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total.tolist(), pa.int64())], names=["at", "n", "total"])

    got = rows.mapInArrow(run, "at int, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("at").collect()
    return (got[0].n, [r.total for r in got]) if got else (0, [])


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact: n times the centred rows."""
    if n * max(1, int(np.abs(x).max())) < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, dtype=object)


def squared_lengths(away: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if away.dtype != object and away.shape[1] * int(np.abs(away).max()) ** 2 < 2**62:
        return (away * away).sum(axis=1).tolist()
    away = away.astype(object)
    return (away * away).sum(axis=1).tolist()


def centred(away: np.ndarray, n: int) -> np.ndarray:
    return away.astype(np.float64) / n


def components_of(rows: DataFrame, d: int, n: int, total: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) of the covariance with divisor n, and unit eigenvectors as columns, at most `most` of them.

    A singular value s of the centred rows is the root of n times an eigenvalue. All d are asked for, as the library then solves
    the d x d problem fully instead of iterating to a tolerance; the driver holds d * d numbers, whatever the rows.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    def run(batches):
        for b in batches:
            if b.num_rows:
                flat = centred(deviations(whole(b, d), n, total), n).reshape(-1)
                ends = pa.array(np.arange(0, len(flat) + 1, d, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(flat))], names=["c"])

    vectors = rows.mapInArrow(run, "c array<double>").select(array_to_vector("c").alias("c"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "c"), n, d).computeSVD(d, False, LEAST_SHARE)
    s = svd.s.toArray()
    return (s**2 / n)[:most], svd.V.toArray()[:, : min(most, len(s))]


def total_variance(rows: DataFrame, d: int, n: int, total: list[int]) -> float:
    """Trace of the covariance, from the exact deviations of all rows: no singular value takes part."""

    def run(batches):
        found = sum(sum(squared_lengths(deviations(whole(b, d), n, total))) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(found)], pa.decimal128(38, 0))], names=["squares"])

    return float(rows.mapInArrow(run, "squares decimal(38,0)").agg(F.sum("squares")).head()[0]) / n / n / n


def whitened_rows(x: np.ndarray, n: int, total: list[int], axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    away = deviations(x, n, total)
    return centred(away, n) @ axes, away


def identity_error(rows: DataFrame, d: int, n: int, total: list[int], axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance (divisor n) less the identity; a task sends its k * (k + 1) sums."""
    k = axes.shape[1]

    def run(batches):
        grams, sums = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                w = whitened_rows(whole(b, d), n, total, axes)[0]
                grams, sums = grams + w.T @ w, sums + w.sum(axis=0)
        values = np.concatenate([grams.reshape(-1), sums])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    got = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    values = np.array([r.value for r in got]) / n
    mean = values[k * k :]
    return float(np.abs(values[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(embeddings: DataFrame, components: int = 32, vector: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened, explained, identity_error: a row per usable row of embeddings.

    Vectors become whole numbers (floor(64 * c) + 1000000); their mean and covariance are over all n usable rows, divisor n.
    whitened: projections of the centred vector on the leading components, each over the root of its eigenvalue; explained: each
    component's share of the total variance; deviation: sum of (n * x - total) squared, exact; identity_error: how far the
    whitened rows' covariance is from the identity, at most.

    Rows without a vector, with an empty one or with null, non-finite or TOO_LARGE entries go; so do vectors of another length than the
    commonest (of equally common ones the longest). Components beyond the rank are left out (variance below LEAST_SHARE
    squared of the largest): one row, or only equal ones, have none, and arrays are empty. An empty table gives an empty one;
    repeated rows and null vec_ids count and give a row each; other columns are not read. The driver and each task hold d * d
    numbers for vectors of length d; the table is read six times and never shuffled.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings, vector)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    id_type = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", id_type), *T._parse_datatype_string(RESULT).fields])
    if not common:
        return spark.createDataFrame([], schema)
    d = common[0].d
    rows = rows.where(F.size("v") == d)
    n, total = sums_of(rows, d)
    trace = total_variance(rows, d, n, total)
    values, axes = (np.zeros(0), np.zeros((d, 0))) if trace == 0 else components_of(rows, d, n, total, components)
    axes = axes / np.sqrt(values)
    error = identity_error(rows, d, n, total, axes) if len(values) else 0.0
    explained = (values / trace).tolist() if len(values) else []
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, k = to_arrow_schema(schema), len(values)

    def run(batches):
        for b in batches:
            if b.num_rows:
                w, away = whitened_rows(whole(b, d), n, total, axes)
                m = b.num_rows
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m * k + 1, k, dtype=np.int32) if k else np.zeros(m + 1, np.int32)), pa.array(w.reshape(-1)))
                deviation = pa.array([Decimal(v) for v in squared_lengths(away)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(m, n)), deviation, lists.cast(arrow.field(3).type), pa.array([explained] * m, arrow.field(4).type), pa.array(np.full(m, error))], schema=arrow)

    return rows.mapInArrow(run, schema)


def whitened_components(embeddings: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: whiten() with a row per component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = whiten(embeddings, components).select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
