"""Notifications that are sent once: a sink for ``foreachBatch`` with retries and a table of what could not be sent.

A batch leaves three tables under ``root``, each complete or not there: the rows it has to send,
what each try sent, and what is left in the end. A batch that comes again, after a
failure or a restart, finds what is complete and goes on from there. A task that
dies between sending and reporting sends again with the same key, by which a
receiver knows it; everything else is sent once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Outbox:
    """``send(key, row)`` runs in tasks and says whether the row was taken; an exception counts as no. Rows are known by ``key``; a null key is never sent."""

    def __init__(self, root: str, send: Callable[[str, dict], bool], key: str = "id", tries: int = 3):
        self.root, self.send, self.key, self.tries = root.rstrip("/"), send, key, tries

    def _complete(self, spark: SparkSession, path: str) -> bool:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _once(self, rows: DataFrame, path: str) -> DataFrame:
        """The table at a path, written from ``rows`` unless it is there."""
        spark = rows.sparkSession
        if not self._complete(spark, path):
            rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def sent(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """batch, key: all that was taken."""
        kind = "key string, ok boolean, batch bigint, nth int"
        rows = spark.read.schema(kind).parquet(f"{self.root}/tries") if self._any(spark, "tries") else spark.createDataFrame([], kind)
        rows = rows.where("ok")
        return (rows if upto is None else rows.where(F.col("batch") < upto)).select("batch", "nth", "key")

    def dead(self, spark: SparkSession) -> DataFrame:
        """batch, key: all that no try could send."""
        none = "key string, batch bigint"
        return spark.read.schema(none).parquet(f"{self.root}/dead") if self._any(spark, "dead") else spark.createDataFrame([], none)

    def _any(self, spark: SparkSession, name: str) -> bool:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        send = self.send
        if self._complete(spark, f"{self.root}/dead/batch={batch_id}"):
            return
        rows = batch.withColumn("key", F.col(self.key).cast("string")).where("key is not null").dropDuplicates(["key"])
        # a key that an earlier batch has sent is not sent again
        rows = rows.join(self.sent(spark, batch_id).select("key").distinct(), "key", "left_anti")
        left = self._once(rows, f"{self.root}/batches/batch={batch_id}")

        def deliver(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                taken = []
                for row in part.to_pylist():
                    try:
                        taken.append(bool(send(row["key"], row)))
                    except Exception:  # whatever the receiver says no by; the row is tried again or kept
                        taken.append(False)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(taken, pa.bool_())], ["key", "ok"])

        for nth in range(self.tries):
            told = self._once(left.mapInArrow(deliver, "key string, ok boolean"), f"{self.root}/tries/batch={batch_id}/nth={nth}")
            left = left.join(told.where("ok").select("key"), "key", "left_anti")
            if left.isEmpty():
                break
        self._once(left.select("key"), f"{self.root}/dead/batch={batch_id}")
