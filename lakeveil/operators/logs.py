"""Append-only logs and the latest state of what they are about; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events(rows: DataFrame, doc: str, kind: str, at: Column, **data: Column) -> DataFrame:
    """doc_id, event_type, event_data (JSON), timestamp: the log lines of one kind of happening."""
    return rows.select(F.col(doc).alias("doc_id"), F.lit(kind).alias("event_type"), F.to_json(F.struct(*[c.alias(k) for k, c in data.items()])).alias("event_data"), at.alias("timestamp"))


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last line of each key; maximums are combined before the shuffle, so a key with very many lines costs no more."""
    rest = [c for c in log.columns if c != key]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("x")
    return log.groupBy(key).agg(last).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def document_status(log: DataFrame) -> DataFrame:
    """doc_id, status, n_events: redacted once a redaction is logged, then processed, else uploaded."""
    has = lambda k: F.max(F.col("event_type") == k)
    status = F.when(has("REDACTION_APPLIED"), "redacted").when(has("PROCESSING_COMPLETE"), "processed").otherwise("uploaded")
    return log.groupBy("doc_id").agg(status.alias("status"), F.count(F.lit(1)).alias("n_events"))


def token_states(issued: DataFrame, revoked: DataFrame, as_of: Column) -> DataFrame:
    """token, expires_at, state (active, revoked, expired) from tokens (token, issued_at, hours_valid) and revocations (token)."""
    gone = revoked.select("token").distinct().withColumn("is_revoked", F.lit(True))
    rows = issued.withColumn("expires_at", F.col("issued_at") + F.make_dt_interval(F.lit(0), F.col("hours_valid"))).join(gone, "token", "left")
    state = F.when(F.col("is_revoked"), "revoked").when(F.col("expires_at") < as_of, "expired").otherwise("active")
    return rows.select("token", "expires_at", state.alias("state"))
