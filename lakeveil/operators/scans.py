"""A scan that can be paused, cancelled and taken up again, with counters that Spark's tasks report.

Files are scanned slice by slice; each slice is one Spark job that appends its rows to the
inventory or, if it is stopped, nothing. What the inventory has with the same path
and hash is not scanned again, so a scan that was cancelled goes on where it
stood, in this session or another, and ends with what an uninterrupted one has.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakeveil.sources.files import unseen

COUNTERS = ["files_scanned", "files_with_pii", "high_risk_files", "medium_risk_files", "low_risk_files"]


@dataclass
class Progress:
    status: str = "idle"
    total_files: int = 0
    files_scanned: int = 0
    files_with_pii: int = 0
    high_risk_files: int = 0
    medium_risk_files: int = 0
    low_risk_files: int = 0
    elapsed_seconds: float = 0.0
    errors_count: int = 0

    @property
    def progress_percent(self) -> float:
        return round(100 * self.files_scanned / self.total_files, 1) if self.total_files else 0.0


def counted() -> list[Column]:
    """Counters of scanned files (entities_count, risk_level), in the order of ``COUNTERS``; levels count where something was found."""
    some = F.col("entities_count") > 0
    level = lambda *names: F.count_if(some & F.col("risk_level").isin(*names))
    each = [F.count(F.lit(1)), F.count_if(some), level("CRITICAL", "HIGH"), level("MEDIUM"), F.count_if(some & ~F.coalesce(F.col("risk_level").isin("CRITICAL", "HIGH", "MEDIUM"), F.lit(False)))]
    return [c.alias(n) for c, n in zip(each, COUNTERS, strict=True)]


class Scan:
    """Scans ``files`` (path, hash and what ``score`` needs) into the Parquet table ``inventory``.

    ``score`` turns files into rows with path, hash, entities_count and
    risk_level. ``slice_of`` deals files over ``slices``; by default a hash of the
    path. ``on_progress`` is called after each slice. Null paths are never known,
    so they are scanned each time.
    """

    def __init__(self, files: DataFrame, score: Callable[[DataFrame], DataFrame], inventory: str, slices: int = 8, slice_of: Column | None = None, on_progress: Callable[[Scan], None] | None = None):
        self.spark: SparkSession = files.sparkSession
        self.files, self.score, self.inventory, self.slices, self.on_progress = files, score, inventory, slices, on_progress
        self.slice_of = F.pmod(F.xxhash64("path"), F.lit(slices)) if slice_of is None else slice_of
        self.state = Progress()
        self.tag = f"scan-{uuid.uuid4().hex}"
        self._stop, self._go = threading.Event(), threading.Event()
        self._go.set()
        self._thread: InheritableThread | None = None

    def scanned(self) -> DataFrame | None:
        """The inventory, or None while there is none."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.inventory)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))
        return self.spark.read.parquet(self.inventory) if there else None

    def start(self) -> dict:
        if self.state.status in ("scanning", "paused"):
            return {"status": "already_scanning"}
        self._stop.clear()
        self._go.set()
        self.state = Progress("scanning")
        self._thread = InheritableThread(target=self._run)
        self._thread.start()
        return {"status": "started"}

    def join(self, seconds: float | None = None) -> Progress:
        if self._thread is not None and self._thread is not threading.current_thread():
            self._thread.join(seconds)
        return self.state

    def pause(self) -> dict:
        """After the slice that runs."""
        if self.state.status != "scanning":
            return {"status": "not_scanning"}
        self._go.clear()
        self.state.status = "paused"
        return {"status": "paused", "progress": self.progress()}

    def resume(self) -> dict:
        if self.state.status != "paused":
            return {"status": "not_paused"}
        self.state.status = "scanning"
        self._go.set()
        return {"status": "resumed", "progress": self.progress()}

    def cancel(self) -> dict:
        """At once: the job that runs is interrupted and leaves nothing."""
        if self.state.status not in ("scanning", "paused"):
            return {"status": "not_scanning"}
        self._stop.set()
        self._go.set()
        self.state.status = "cancelled"
        self.spark.interruptTag(self.tag)
        return {"status": "cancelled", "progress": self.progress()}

    def progress(self) -> dict:
        return asdict(self.state) | {"progress_percent": self.state.progress_percent}

    def _add(self, counts: dict) -> None:
        for name in COUNTERS:
            setattr(self.state, name, getattr(self.state, name) + (counts[name] or 0))

    def _run(self) -> None:
        began = time.monotonic()
        self.spark.addTag(self.tag)
        try:
            self.state.total_files = self.files.count()
            if (seen := self.scanned()) is not None:
                now = seen.join(self.files.select("path", "hash"), ["path", "hash"], "left_semi")
                self._add(now.agg(*counted()).first().asDict())
            for k in range(self.slices):
                self._go.wait()
                if self._stop.is_set():
                    return
                part = self.files.where(self.slice_of == k)
                if (seen := self.scanned()) is not None:
                    part = unseen(part, seen)
                watch = Observation()
                self.score(part).observe(watch, *counted()).write.mode("append").parquet(self.inventory)
                self._add(watch.get)
                self.state.elapsed_seconds = round(time.monotonic() - began, 1)
                if self.on_progress:
                    self.on_progress(self)
            self.state.status = "cancelled" if self._stop.is_set() else "completed"
        except (PySparkException, Py4JError):
            if not self._stop.is_set():  # a job that was interrupted is no error
                self.state.status, self.state.errors_count = "error", self.state.errors_count + 1
                raise
        finally:
            self.spark.removeTag(self.tag)
