"""Sessions as the engine wants them: UTC, adaptive execution, shuffle partitions by the size of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("sparkfolio")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which checkpoint() uses from here on.

    A session on one machine (local[...]) that names none gets a new folder there; on a cluster a machine's own folder
    would be lost to the others, so that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if found is None and held.isDefined():
        found = held.get()
    if found is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkfolio-shared-")
    if not held.isDefined():
        sc.setCheckpointDir(found)
    return found


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable."""
    shared_folder(spark)


def stored(df: DataFrame, *partitions: str) -> DataFrame:
    """df as a Parquet table in the shared folder, split by columns if any are named: what several plans read is made once, and its
    size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partitions) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more, in whatever store they lie."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
