"""The watcher as Structured Streaming: new files or rows are scanned once, and recent findings are kept.

A file source reads each file once and its log survives restarts, which is the
path deduplication; ``debounced`` holds a path back until it has been there for
a while; a stopped query goes on from its checkpoint, which is pause and resume.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from lakeveil.operators import risk, spans


def watch_text(spark: SparkSession, folder: str, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """path, text, modified of files as they appear in a folder, below it too."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files)
    return files.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def watch_table(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def detect_stream(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, score, level, types for rows with hits; stateless, so it runs on streams and tables alike."""
    found = rows.select(key, spans.watcher_spans(F.coalesce("text", F.lit(""))).alias("found")).where(F.size("found") > 0)
    score, level = risk.quick_score(F.size("found").cast("bigint"), 15, 40)
    return found.select(key, F.size("found").cast("bigint").alias("n"), score.alias("score"), level.alias("level"), F.array_join(risk.types_of(F.col("found")), ",").alias("types"))


def drop_repeats(rows: DataFrame, time: str, delay: str, *keys: str) -> DataFrame:
    """The first of equal keys within ``delay``; state older than the watermark is dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def drop_recent_contents(rows: DataFrame, size: int = 100) -> DataFrame:
    """Rows (path, text) whose text is not among the last ``size`` distinct ones; the state is that list of hashes.

    The list is one for the whole stream, as first-in first-out by count is;
    ``drop_repeats`` is the variant whose state is spread over the cluster.
    """

    def step(_key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            keep = []
            for text in frame["text"].fillna(""):
                mark = hashlib.md5(text.encode("utf-8", "replace")).hexdigest()
                keep.append(mark not in recent)
                if keep[-1]:
                    recent = [*recent, mark][-size:]
            yield frame.loc[keep, ["path", "text"]]
        state.update((recent,))

    keyed = rows.select("path", "text").withColumn("one", F.lit(0))
    return keyed.groupBy("one").applyInPandasWithState(step, "path string, text string", "recent array<string>", "append", "NoTimeout")


def debounced(rows: DataFrame, seconds: float = 2.0) -> DataFrame:
    """path, text of rows (path, text), once for each path, when its first row is ``seconds`` old; repeats meanwhile don't start the wait anew.

    State is kept by path and spread over the cluster; it ends with the wait.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            text = state.get[0]
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "text": [text]})
            return
        last = None
        for frame in frames:
            last = frame["text"].iloc[-1] if len(frame) else last
        fresh = not state.exists
        state.update((last,))
        if fresh:
            state.setTimeoutDuration(int(seconds * 1000))

    return rows.select("path", "text").groupBy("path").applyInPandasWithState(step, "path string, text string", "text string", "append", "ProcessingTimeTimeout")


def keep_recent(target: str, size: int = 50, order: str = "score") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a table of the newest ``size`` findings, newest batch first. Replayed batches replace themselves."""

    def write(batch: DataFrame, number: int) -> None:
        top = batch.orderBy(F.desc(order), *[c for c in batch.columns if c != order]).limit(size)
        top.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write


def recent(spark: SparkSession, target: str, size: int = 50) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.orderBy(F.desc("batch"), F.desc("score")).limit(size)


def windowed_metrics(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in sliding windows; on a stream, windows close when the watermark passes them."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", length, slide).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "least", "most"
    )


def drained(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what there is now to a Parquet folder, and stop; a second run goes on where this ended."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
