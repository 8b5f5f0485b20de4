"""Audit chains, roles, feedback, playbooks and reports as transforms of tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import lakeveil
from lakeveil.functions import rules as R
from lakeveil.sources.tables import kept

cloudpickle.register_pickle_by_value(lakeveil)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC from two hashes with the padded key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


CHAIN = ["prev_hash", "event_type", "actor", "resource", "action", "details", "timestamp"]


def payload() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in CHAIN])


def build_chain(events: DataFrame, order: str, group: str, key: bytes) -> DataFrame:
    """Append-only chains, one for each group: every entry's hash covers its predecessor's.

    A chain is sequential by nature: a group's events pass through one task in
    order, as a stream that holds the last hash and nothing else. Groups are
    independent of each other and spread over the cluster; signatures are made
    after that, in parallel. For proofs inside a long chain see ``merkle``.
    """
    fields = [c for c in CHAIN if c != "prev_hash"]
    columns = [order, *fields] if group in fields else [group, order, *fields]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = object(), ""
        for b in batches:
            prev, entry = [], []
            for g, *values in zip(*(b.column(c).to_pylist() for c in ("_group", *fields)), strict=True):
                if g != now:
                    now, last = g, "0" * 64
                prev.append(last)
                last = hashlib.sha256("|".join([last, *("" if v is None else v for v in values)]).encode("utf-8", "replace")).hexdigest()
                entry.append(last)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(prev, pa.string()), pa.array(entry, pa.string())], [*columns, "prev_hash", "entry_hash"])

    text = {c: F.col(c).cast("string") for c in fields}
    rows = events.withColumn("_group", F.to_json(F.struct(group))).withColumns(text).select("_group", *columns)
    dealt = rows.repartition("_group").sortWithinPartitions("_group", order)
    schema = ", ".join([*[f"`{c}` {'string' if c in fields else kinds[c]}" for c in columns], "prev_hash string", "entry_hash string"])
    return dealt.mapInArrow(run, schema).withColumn("hmac_signature", hmac_sha256(key, payload()))


def ranked(rows: DataFrame, order: str, group: str, carried: str) -> DataFrame:
    """Adds nth (from 1) and ``before`` (what the entry before has in ``carried``) by group, in order.

    Rows are dealt by ranges of group and order, so a group with most of the rows is
    spread too; only counts and last rows by partition are put in a row of their own.
    """
    dealt = kept(rows.withColumn("_g", F.to_json(F.struct(group))).repartitionByRange("_g", order).withColumn("_part", F.spark_partition_id()))
    edges = dealt.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.max_by(carried, order).alias("_last"))
    by = Window.partitionBy("_g").orderBy("_part")
    edges = edges.withColumns({"_from": F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_last": F.lag("_last").over(by)})
    inside = Window.partitionBy("_part", "_g").orderBy(order)
    own = dealt.join(edges.drop("_n"), ["_g", "_part"])
    nth, first = F.row_number().over(inside), F.lag(carried).over(inside)
    return own.withColumns({"nth": (F.col("_from") + nth).cast("bigint"), "before": F.when(nth == 1, F.col("_last")).otherwise(first)}).drop("_g", "_part", "_from", "_last")


def verify_chain(chain: DataFrame, order: str, group: str, key: bytes) -> DataFrame:
    """group, n, broken_at: the first entry (from 1) whose hash, signature or link is wrong; null if all hold."""
    rows = ranked(chain, order, group, "entry_hash")
    linked = F.col("prev_hash") == F.coalesce("before", F.lit("0" * 64))
    good = (F.col("entry_hash") == F.sha2(payload(), 256)) & (F.col("hmac_signature") == hmac_sha256(key, payload()))
    rows = rows.select(group, "nth", F.coalesce(good & linked, F.lit(False)).alias("holds"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("holds"), F.col("nth"))).cast("int").alias("broken_at"))


def chain_status(chain: DataFrame, order: str, group: str) -> DataFrame:
    """group, total_entries, last_hash, status of each chain."""
    rows = chain.groupBy(group).agg(F.count(F.lit(1)).alias("total_entries"), F.max_by("entry_hash", order).alias("last_hash"))
    return rows.withColumn("status", F.lit("active"))


def feedback_stats(feedback: DataFrame, by: str = "entity_type") -> DataFrame:
    """total, correct, incorrect, accuracy and fp_rate (3 digits) of marks (is_correct 0/1)."""
    stats = feedback.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum("is_correct").alias("correct"))
    return stats.withColumn("incorrect", F.col("total") - F.col("correct")).withColumns(
        {"accuracy": F.bround(F.col("correct") / F.col("total"), 3), "fp_rate": F.bround(F.col("incorrect") / F.col("total"), 3)}
    )


def threshold_advice(stats: DataFrame, by: str = "entity_type") -> DataFrame:
    """increase with a boost where over 0.3 of at least 5 marks are wrong; decrease where under 0.05 of at least 10 are."""
    up, down = F.col("fp_rate") > 0.3, (F.col("fp_rate") < 0.05) & (F.col("total") >= 10)
    advised = stats.where(F.col("total") >= 5).where(up | down)
    return advised.select(
        by,
        F.when(up, "increase_threshold").otherwise("decrease_threshold").alias("recommendation"),
        F.when(up, F.bround(F.least(F.col("fp_rate") * 0.3, F.lit(0.2)), 2)).otherwise(F.lit(0.05)).alias("change"),
    )


def rank_p95(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The value at place min(floor(0.95 n), n - 1), from 0, of the sorted values, for each group.

    Equal values are counted before they are ordered, so a group's window has a row for each distinct value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    placed = counts.select(by, value, "c", F.sum("c").over(w.orderBy(value)).alias("upto"), F.sum("c").over(w).alias("n"))
    at = F.least(F.floor(F.col("n") * 95 / 100), F.col("n") - 1)
    return placed.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(by, F.col(value).alias("p95"), "n")


def role_permissions(spark) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in R.ROLES.items() for p in ps], "role string, permission string")


def playbook_progress(executions: DataFrame) -> DataFrame:
    """Adds severity, n_steps, step (null once done) and status to rows with playbook and steps_done."""
    out = F.lit(None).cast("array<string>")
    severity = F.lit(None).cast("string")
    for name, (level, steps) in R.PLAYBOOKS.items():
        out = F.when(F.col("playbook") == name, F.array(*map(F.lit, steps))).otherwise(out)
        severity = F.when(F.col("playbook") == name, level).otherwise(severity)
    rows = executions.withColumn("steps", out).withColumn("severity", severity).withColumn("n_steps", F.size("steps").cast("bigint"))
    done = F.col("steps_done") >= F.col("n_steps")
    return rows.withColumn("step", F.when(~done, F.get("steps", F.col("steps_done").cast("int")))).withColumn("status", F.when(done, "completed").otherwise("in_progress")).drop("steps")


def compliance_report(spark, types: DataFrame) -> DataFrame:
    """Every template's sections, filled from the types found. ``types``: one row, entity_types (array)."""
    sections = spark.createDataFrame([(t, i, s) for t, ss in R.TEMPLATES.items() for i, s in enumerate(ss)], "template string, nth int, section string")
    s = F.lower("section")
    has = lambda *words: F.expr(" or ".join(f"contains(lower(section), '{w}')" for w in words))
    listed = F.when(F.size("entity_types") > 0, F.concat(F.lit("Detected entity types: "), F.array_join("entity_types", ", "))).otherwise("No PII detected in scan")
    filled = (
        F.when(has("personal data", "pi collected", "phi"), listed)
        .when(has("encryption"), "AES-256 encryption available via Secure Vault")
        .when(has("retention", "storage"), "Review file retention policies — files in vault are encrypted at rest")
        .when(has("access"), "RBAC system with role-based permissions and approval workflows")
        .when(has("breach"), "Incident playbooks available for PII leak response")
        .otherwise("Manual review required")
    )
    found = types.first()
    names = list(found[0] or []) if found else []  # a type for each rule at most
    return sections.withColumn("entity_types", F.array(*map(F.lit, names)).cast("array<string>")).withColumn("s", s).select("template", "nth", "section", filled.alias("content"))


def reveal(requests: DataFrame, tokens: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """request_id, decision: invalid, denied_revoked, denied_expired, not_found, denied_wrong_key or success, in this order."""
    t = tokens.select(F.col("token"), "item_id", "revoked", "expires_at")
    i = items.select(F.col("item_id").alias("item"), "key_hash")
    joined = requests.join(t, "token", "left").join(i, F.col("item_id") == F.col("item"), "left")
    decision = (
        F.when(F.col("item_id").isNull(), "invalid")
        .when(F.col("revoked"), "denied_revoked")
        .when(F.col("expires_at") < as_of, "denied_expired")
        .when(F.col("item").isNull(), "not_found")
        .when(F.sha2("key", 256) != F.col("key_hash"), "denied_wrong_key")
        .otherwise("success")
    )
    return joined.select("request_id", decision.alias("decision"))
