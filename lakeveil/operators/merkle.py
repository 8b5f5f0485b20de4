"""Audit entries in Merkle segments: appended, verified and proved in parallel inside one actor's log.

The entries of a log, in order, make segments of ``SIZE``. A segment's root
covers its entries; a checkpoint covers a segment's root and the checkpoint before, so
what is sequential is a segment long only once in ``SIZE`` entries. Whoever has a
checkpoint can be shown that an entry is in the log by the siblings on its way to the
root, without the other entries. A level pairs neighbours; an odd last one goes up
by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import governance as G

SIZE = 256
FIELDS = [c for c in G.CHAIN if c != "prev_hash"]
EMPTY = "0" * 64


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def leaf() -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS]), 256)


def leaves(events: DataFrame, order: str, group: str, size: int = SIZE) -> DataFrame:
    """group, nth (from 1), segment, place (both from 0), leaf."""
    rows = G.ranked(events.withColumn("leaf", leaf()).select(group, order, "leaf"), order, group, "leaf")
    return rows.select(group, order, "nth", F.expr(f"(nth - 1) div {size}").alias("segment"), ((F.col("nth") - 1) % size).cast("int").alias("place"), "leaf")


def _up(level: Column) -> Column:
    """The level above: hashes of pairs."""
    at = lambda i: F.get(level, i)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda i: F.when(at(2 * i + 1).isNull(), at(2 * i)).otherwise(F.sha2(F.concat(at(2 * i), at(2 * i + 1)), 256)))


def _levels(size: int) -> int:
    return max(1, (size - 1).bit_length())


def root(level: Column, size: int = SIZE) -> Column:
    for _ in range(_levels(size)):
        level = let(level, _up)
    return F.get(level, F.lit(0))


def proof(level: Column, place: Column, size: int = SIZE) -> Column:
    """side (of the sibling: l, r, or none where there is none) and hash, from the leaf up."""

    def step(level: Column, depth: int, out: Column) -> Column:
        at = F.shiftright(place, depth)
        own = let(F.get(level, F.when(at % 2 == 0, at + 1).otherwise(at - 1)), lambda h: F.struct(F.when(h.isNull(), "none").when(at % 2 == 0, "r").otherwise("l").alias("side"), F.coalesce(h, F.lit("")).alias("hash")))
        out = F.concat(out, F.array(own))
        return out if depth + 1 == _levels(size) else let(_up(level), lambda up: step(up, depth + 1, out))

    return let(level, lambda xs: step(xs, 0, F.array().cast("array<struct<side:string,hash:string>>")))


def climbed(leaf_hash: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    up = lambda h, p: F.when(p["side"] == "r", F.sha2(F.concat(h, p["hash"]), 256)).when(p["side"] == "l", F.sha2(F.concat(p["hash"], h), 256)).otherwise(h)
    return F.aggregate(path, leaf_hash, up)


def segments(found: DataFrame, group: str, size: int = SIZE) -> DataFrame:
    """group, segment, n, root of ``leaves``; a segment has ``size`` entries at most."""
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"])
    rows = found.groupBy(group, "segment").agg(hashes.alias("level"))
    return rows.select(group, "segment", F.size("level").cast("bigint").alias("n"), root(F.col("level"), size).alias("root"))


def checkpoints(roots: DataFrame, group: str, key: bytes) -> DataFrame:
    """group, segment, n, root, entry_hash, hmac_signature: the roots of each group as a chain of their own, one entry for ``SIZE`` events."""
    blank = [F.lit(None).cast("string").alias(c) for c in FIELDS if c not in ("actor", "details")]
    rows = roots.select("segment", F.col(group).cast("string").alias("actor"), F.concat_ws(":", F.col("n").cast("string"), "root").alias("details"), *blank)
    made = G.build_chain(rows, "segment", "actor", key)
    return made.select(F.col("actor").alias(group), "segment", F.substring_index("details", ":", 1).cast("bigint").alias("n"), F.substring_index("details", ":", -1).alias("root"), "prev_hash", "entry_hash", "hmac_signature")


def verify(events: DataFrame, made: DataFrame, order: str, group: str, key: bytes, size: int = SIZE) -> DataFrame:
    """group, segments, broken_segment, chain_broken_at: the first segment (from 0) whose entries no longer make its root or that is missing, and the first checkpoint (from 1) that doesn't hold; null if all do."""
    now = segments(leaves(events, order, group, size), group, size).select(F.col(group).cast("string").alias("g"), F.col("segment").alias("s"), F.col("n").alias("now_n"), F.col("root").alias("now_root"))
    both = made.join(now, F.col(group).eqNullSafe(F.col("g")) & (F.col("segment") == F.col("s")), "full_outer")
    same = (F.col("root") == F.col("now_root")) & (F.col("n") == F.col("now_n"))
    rows = both.select(F.when(F.col("segment").isNull(), F.col("g")).otherwise(F.col(group)).alias(group), F.coalesce("segment", "s").alias("segment"), F.coalesce(same, F.lit(False)).alias("same"))
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("segments"), F.min(F.when(~F.col("same"), F.col("segment"))).alias("broken_segment"))
    chain = made.select("segment", F.col(group).alias("actor"), F.concat_ws(":", F.col("n").cast("string"), "root").alias("details"), "prev_hash", "entry_hash", "hmac_signature", *[F.lit(None).cast("string").alias(c) for c in FIELDS if c not in ("actor", "details")])
    held = G.verify_chain(chain, "segment", "actor", key).select(F.col("actor").alias("a"), F.col("broken_at").alias("chain_broken_at"))
    return found.join(held, F.col(group).eqNullSafe(F.col("a")), "left").drop("a")


def proofs(found: DataFrame, wanted: DataFrame, order: str, group: str, size: int = SIZE) -> DataFrame:
    """group, order, segment, leaf, path for the entries of ``wanted`` (group, order): only their segments are gathered."""
    asked = found.join(wanted.select(group, order), [group, order]).select(group, order, "segment", "place", F.col("leaf").alias("own"))
    levels = found.join(asked.select(group, "segment").distinct(), [group, "segment"]).groupBy(group, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "leaf"))), lambda x: x["leaf"]).alias("level"))
    return asked.join(levels, [group, "segment"]).select(group, order, "segment", F.col("own").alias("leaf"), proof(F.col("level"), F.col("place"), size).alias("path"))
