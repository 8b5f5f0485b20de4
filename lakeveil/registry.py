"""Every query of the engine by name, with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeveil.plans import audit, coordinates, detection, extras, names, relational, reports, scans, semantic, stores, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**detection.QUERIES, **relational.QUERIES, **streams.QUERIES, **extras.QUERIES, **reports.QUERIES, **semantic.QUERIES, **names.QUERIES, **scans.QUERIES, **audit.QUERIES, **stores.QUERIES, **coordinates.QUERIES}
ORACLE: dict[str, str] = {**detection.ORACLE, **relational.ORACLE, **streams.ORACLE, **extras.ORACLE, **reports.ORACLE, **semantic.ORACLE, **names.ORACLE, **scans.ORACLE, **audit.ORACLE, **stores.ORACLE, **coordinates.ORACLE}
