"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lakeveil

#: Functions of this package travel to Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(lakeveil)

#: ASCII white space, as in the word rule ``[^\x20\x09-\x0D]+``.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it. Only where that is unset (tests on one
    machine) is a temporary folder made and set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="lakeveil-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage, keeps later passes from repeating the work, and fixes
    values such as row numbers for every later reader. The tables of a session
    are deleted when it ends, and by ``release`` before.
    """
    spark = df.sparkSession
    home = f"{scratch_root(spark)}/lakeveil/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_delete, spark, home)
    path = f"{home}/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Rows of jobs inside go to Python in Arrow batches of about ``size``; Spark's 64 MB are held twice, by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_HOMES: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _delete(t.sparkSession, path)


def sift(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, least: int = 12, most: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``wanted``; none that is there gets lost.

    A bitmap of the wanted keys' hashes, of at most ``2**most`` bits and so of at
    most ``2**most / 64`` rows however large the tables are, is broadcast. What
    it lets through by chance, a join afterwards takes out. Null keys go.
    """
    n = wanted.count()
    bits = min(most, max(least, n.bit_length() + 4))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    maps = wanted.where(F.col(wanted_key).isNotNull()).select(bit(F.col(wanted_key)).alias("bit"))
    maps = maps.groupBy(F.expr("bit div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("_bits"))
    inside = F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, cast(_bit % 64 as int))")) != 0
    marked = rows.where(key.isNotNull()).withColumn("_bit", bit(key)).withColumn("_word", F.expr("_bit div 64"))
    return marked.join(F.broadcast(maps), "_word").where(inside).select(*rows.columns)


def wrapped(docs: DataFrame) -> DataFrame:
    """All columns of a table in one, ``row``, so that columns beside it can't clash with them."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def sliced(batches, rows: int = 500):
    """The same rows in batches of at most ``rows``, so that few texts are unpacked at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
