"""What the operators of this subpackage share: the shared folder, tables in it, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shipping
from ..session import shared_folder

#: Bytes and rows of an Arrow batch between Spark and Python, in which whole texts of any length travel. Spark's own bounds suit
#: numbers; a batch is held several times over, by either side, in every task.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000
#: Bytes of strings that one call of a mapped function gets, about.
CHUNK_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Gives executors this package, and bounds Arrow batches where the session leaves Spark's defaults."""
    shipping.ship(spark)
    for key, default, value in (("maxBytesPerBatch", "67108864b", BATCH_BYTES), ("maxRecordsPerBatch", "10000", BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name) == default:
            spark.conf.set(name, str(value))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, without a slash at its end."""
    return shared_folder(spark).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there: later steps neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """As cut(), but as Parquet: smaller on disk, and read again with its columns pruned and its size known, so that the
    planner decides by size whether to broadcast it in a join."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables of table() that nothing reads any more."""
    for df in tables:
        drop_folder(df.sparkSession, df._table_path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written here and that nothing reads any more, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(df: DataFrame, name: str = "text") -> DataFrame:
    """doc_id and text alone, so that extra columns are pruned at the scan and clashing names can't matter."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("string").alias("text"))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches re-cut so that each holds about CHUNK_BYTES, a row at least: what is turned into Python objects at a time."""
    for batch in batches:
        n = batch.num_rows
        if n:
            each = max(1, int(n * min(1.0, CHUNK_BYTES / max(1, batch.nbytes))))
            for at in range(0, n, each):
                yield batch.slice(at, each)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], list]], schema: str) -> DataFrame:
    """Runs a function over batches of rows (lists, a list for each column) in Arrow; make() is called once per task.

    The function gets the columns of df and returns the columns of the schema, with as many rows as it likes.
    """
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in parts_of(batches):
            out = step([c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)


def map_column(df: DataFrame, source: str, make: Callable[[], Callable[[list], list]], out: str, kind: T.DataType) -> DataFrame:
    """df with a column out at its end: a function of the column source. Other columns pass as they are, never as Python objects."""
    from pyspark.sql.pandas.types import to_arrow_type

    struct = T.StructType([*df.schema.fields, T.StructField(out, kind)])
    arrow, at, names = to_arrow_type(kind), df.columns.index(source), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in parts_of(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(step(part.column(at).to_pylist()), arrow)], names=names)

    return df.mapInArrow(run, struct)
