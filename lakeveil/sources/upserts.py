"""Tables of hash buckets that are changed by upserts, batch by batch, each batch once.

A batch rewrites the buckets that its keys fall in, beside the old ones, and then
commits a manifest: which folder each bucket is read from, and which batches are
in. A manifest is a new file that only one writer can create, so readers see all of
a batch or nothing, a batch that comes again is known, and a writer that finds that
another one was faster starts again from the newer manifest. Old folders stay for
readers that hold an older manifest, until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(order: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Of each key the row with the highest value of ``order``; ties by all other columns, so the order of batches plays no part."""

    def merge(rows: DataFrame, key: list[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in key and c != order]
        by = Window.partitionBy(*key).orderBy(F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest])
        return rows.withColumn("_nth", F.row_number().over(by)).where("_nth = 1").drop("_nth")

    return merge


def keep_first(order: str, updated: dict[str, Column] | None = None) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Of each key the row with the lowest value of ``order``, with ``updated`` columns as aggregates over all of its rows."""

    def merge(rows: DataFrame, key: list[str]) -> DataFrame:
        own = [c for c in rows.columns if c not in key and c not in (updated or {})]
        first = F.min(F.struct(order, *[c for c in own if c != order])).alias("_first")
        return rows.groupBy(*key).agg(first, *[c.alias(n) for n, c in (updated or {}).items()]).select(*[F.col(c) if c in key or c in (updated or {}) else F.col(f"_first.{c}").alias(c) for c in rows.columns])

    return merge


class BucketTable:
    """``merge`` makes one row of each key from the rows that there are; it must give the same whatever the order of batches."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: list[str], merge: Callable[[DataFrame, list[str]], DataFrame], buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.merge, self.buckets = spark, root.rstrip("/"), schema, key, merge, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """version, buckets (number to folder), batches (all that are in)."""
        home = self._path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not versions:
            return {"version": 0, "buckets": {}, "batches": []}
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/{versions[-1]:012d}.json").first()[0]
        return json.loads(text)

    def _commit(self, state: dict) -> bool:
        """Whether this writer's manifest is the next; it is written whole under another name and then renamed, which fails where there is one."""
        home = f"{self.root}/manifests"
        draft, final = self._path(f"{home}/.{uuid.uuid4().hex}.tmp"), self._path(f"{home}/{state['version']:012d}.json")
        self._fs.mkdirs(self._path(home))
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        sc = self.spark.sparkContext
        jvm = sc._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(draft, final, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def read(self) -> DataFrame:
        return self._rows(self.manifest()["buckets"])

    def _rows(self, buckets: dict[str, str]) -> DataFrame:
        paths = sorted(f"{self.root}/{folder}/bucket={b}" for b, folder in buckets.items() if folder)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, batch: DataFrame, batch_id: str) -> list[int]:
        """The buckets rewritten; none if the batch is in already. Rows with a null in their key go by it like by any other value."""
        batch = batch.select(*self.schema.fieldNames())
        while True:
            state = self.manifest()
            if batch_id in state["batches"]:
                return []
            bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
            touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets, at most
            old = self._rows({b: f for b, f in state["buckets"].items() if int(b) in touched})
            rows = self.merge(old.unionByName(batch), self.key).withColumn("bucket", bucket)
            folder = f"data/{uuid.uuid4().hex}"
            rows.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            if self._commit({"version": state["version"] + 1, "buckets": state["buckets"] | {str(b): folder for b in touched}, "batches": [*state["batches"], batch_id]}):
                return sorted(touched)

    def vacuum(self) -> int:
        """Deletes the folders that the last manifest doesn't name, such as those of writers that were lost; how many."""
        used = {f.split("/")[1] for f in self.manifest()["buckets"].values()}
        home = self._path(f"{self.root}/data")
        gone = [s.getPath() for s in self._fs.listStatus(home) if s.getPath().getName() not in used] if self._fs.exists(home) else []
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
