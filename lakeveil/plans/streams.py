"""Queries that run as streams, drained over the tables there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeveil.functions import rules as R
from lakeveil.sources.tables import scratch, table
from lakeveil.streaming import watch

from . import sql as S


def _drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    root = scratch(spark)
    watch.drained(stream, f"{root}/out", f"{root}/log")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, as a table may be one file or a folder of them
    return watch.watch_table(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def stream_detect(spark: SparkSession, d: str) -> DataFrame:
    return _drain(spark, watch.detect_stream(_source(spark, d, "documents")))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return _drain(spark, watch.drop_repeats(rows, "ts", "60 days", "user_id", "event_type")).select("user_id", "event_type")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of a day, one every six hours, as a stream: an open window waits for the watermark, so the last ones are left out."""
    rows = _source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drain(spark, watch.windowed_metrics(rows, "24 hours", "6 hours", "1 hour"))


def table_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows over a whole table, a day at a time."""
    return watch.windowed_metrics(table(spark, d, "events"), "24 hours", "24 hours")


QUERIES = {"stream_detect": stream_detect, "stream_dedup": stream_dedup, "stream_windows": stream_windows, "window_metrics": table_windows}

ORACLE = {
    "stream_detect": f"""with {S.raw_spans(R.WATCHER)}, c as (select doc_id, count(*) n, list_sort(list_distinct(list(type))) types from raw group by doc_id)
select doc_id, n, least(15 * n, 100)::bigint score, case when 15 * n > 70 then 'HIGH' when 15 * n > 40 then 'MEDIUM' else 'LOW' end as level, array_to_string(types, ',') types from c""",
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_windows": """with w as (select time_bucket(interval 6 hours, ts) - to_hours(6 * k) start, event_type, value from events, range(4) r(k)), m as (select max(ts) - interval 1 hour closed from events)
select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n, min(value) least, max(value) most from w, m where start + interval 24 hours <= closed group by 1, 2""",
    "window_metrics": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n, min(value) least, max(value) most from events group by 1, 2",
}
