"""Readers of tables, and tables for intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; only on one machine one is made where that is unset.

    What a session has written there is deleted when it ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lakeveil-")
        spark.conf.set("spark.checkpoint.dir", root)
    home = f"{root.rstrip('/')}/lakeveil/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_delete, spark, home)
    return f"{home}/{uuid.uuid4().hex}"


_HOMES: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder and read back: lineage ends there, and its work is done once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``kept`` that nothing will read again, before the session ends."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _delete(t.sparkSession, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; only what a query uses is read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read by fewer tasks than there are cores, dealt evenly over them, for work that is heavy for each row.

    A table of as many files as cores is left as it is. Of others the tasks that
    have rows are counted, as a split without the middle of a row group has none;
    footers are all that this reads. What is dealt is a task's rows a core at most.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    full = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if full >= cores else df.repartition(cores)
