"""Near copies by the Jaccard coefficient of word shingles: MinHash bands find, the exact sets decide.

1. A document's distinct shingles have MinHash values in bands of ``ROWS``; the
   number of bands is tuned for the wanted recall at the least similarity.
2. In each bucket (documents with one band value) all are compared with the
   smallest id, on their exact sets. What agrees is linked.
3. In buckets that still hold several components, all pairs of different
   components are compared: what is outside the largest component with it and
   with itself, in pairs of blocks that are tasks of their own, so a large
   group of copies is never compared within itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sift, sliced
from .components import components
from .hashes import Words, mix, shingled, tune_bands

ROWS = 4


def shingles(text: str | None, size: int, cache: Words) -> np.ndarray:
    """Distinct, sorted; words are as in ``simhash``, and a text of fewer words than a shingle is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - size + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    return np.unique(shingled(cache.of(words), size))


def _buckets(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, key: a row for each document and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for b in sliced(batches, 200):
            if not b.num_rows:
                continue
            sets = [shingles(t, size, cache) for t in b.column("text").to_pylist()]
            starts = np.cumsum([0, *map(len, sets[:-1])])
            both = np.concatenate(sets)
            for band in range(bands):
                key = np.full(b.num_rows, band, np.uint64)
                for k in range(ROWS):
                    low = np.minimum.reduceat(mix(both ^ np.uint64(0x1000193 * (2 * (band * ROWS + k) + 1))), starts)
                    key = mix(key * np.uint64(31) + low)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(key.view(np.int64))], ["doc_id", "key"])

    return docs.mapInArrow(run, "doc_id bigint, key bigint")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for b in sliced(batches, 200):
            sets = [shingles(t, size, cache).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def near_links(docs: DataFrame, similarity: float = 0.8, recall: float = 0.995, shingle: int = 5, block: int = 256, found: DataFrame | None = None) -> DataFrame:
    """a, b: ids of links whose components are those of all pairs that are found and reach the similarity.

    ``found`` (doc_id, key) are buckets of documents that another search has found; the exact sets decide on these too.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = _buckets(texts, shingle, tune_bands(similarity, recall, ROWS))
    rows = materialize(rows if found is None else rows.unionByName(found), "bands")
    return linked(rows, lambda ids: _sets(sift(texts, F.col("doc_id"), ids, "doc_id").join(ids, "doc_id", "left_semi"), shingle), similarity, block)


def linked(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, block: int, joined: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """a, b: links of ids that meet in a bucket. ``rows``: doc_id, key. ``sets_of`` gives doc_id, shingles for a table of ids, ``joined`` the components of links."""
    shared = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last").select("key", "pivot"), "shared")
    members = materialize(sift(rows, F.col("key"), shared, "key").join(shared, "key").select("key", "pivot", "doc_id").distinct(), "buckets")
    release(rows)
    sets = materialize(sets_of(materialize(members.select("doc_id").distinct(), "ids")), "sets")
    pairs = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    links = materialize(pairs.join(x, "a").join(y, "b").where(same >= similarity * (F.size("x") + F.size("y") - same)).select("a", "b").distinct(), "pivots")
    found = joined(links)
    star = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))  # one link a node does for all of them
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    # a bucket of two has had its comparison; of the others the members of the largest component need none among themselves
    parts = materialize(placed.groupBy("key", "component").agg(F.count("*").alias("n")), "parts")
    open_ = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("big")).where("parts > 1 and n > 2")
    open_ = materialize(open_.select("key", F.col("big.component").alias("big"), F.expr(f"cast(ceil(n / {block}) as int)").alias("blocks"), F.expr(f"cast(ceil((n - big.n) / {block}) as int)").alias("rest_blocks")), "open")
    if open_.isEmpty():
        return star
    at = placed.join(open_, "key").withColumn("hash", F.xxhash64("doc_id")).withColumn("rest", F.col("component") != F.col("big"))
    own = F.pmod("hash", F.when(F.col("rest"), F.col("rest_blocks")).otherwise(F.col("blocks"))).cast("int")
    dealt = materialize(at.withColumn("own", own).select("key", "doc_id", "component", "rest", "own", "blocks", "rest_blocks"), "dealt")
    # the rest against the largest component, and the rest against itself, as pairs of blocks
    columns = ["key", "one", "two", "doc_id", "component", "side"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest, big = dealt.where("rest"), dealt.where("not rest")
    tasks = (
        rest.withColumn("two", every("blocks")).select("key", F.col("own").alias("one"), "two", "doc_id", "component", F.lit(0).alias("side"))
        .unionByName(big.withColumn("one", every("rest_blocks")).select("key", "one", F.col("own").alias("two"), "doc_id", "component", F.lit(1).alias("side")))
        .unionByName(rest.withColumn("with", every("rest_blocks")).select("key", (-1 - F.least("own", "with")).alias("one"), (-1 - F.greatest("own", "with")).alias("two"), "doc_id", "component", F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("side")))
    ).select(*columns)

    def compare(table: pa.Table) -> pa.Table:
        ids, label = table.column("doc_id").to_numpy(), table.column("component").to_numpy().copy()
        side, cross = table.column("side").to_numpy(), table.column("one")[0].as_py() != table.column("two")[0].as_py() or table.column("one")[0].as_py() >= 0
        held, out = [np.asarray(s.values) for s in table.column("shingles")], []
        for i in range(len(ids)):
            for j in np.flatnonzero(label[i + 1 :] != label[i]) + i + 1:
                if label[j] != label[i] and not (cross and side[i] == side[j]):
                    n = len(np.intersect1d(held[i], held[j], assume_unique=True)) if similarity * len(held[i]) <= len(held[j]) <= len(held[i]) / similarity else 0
                    if n >= similarity * (len(held[i]) + len(held[j]) - n):
                        out.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table([pairs[:, 0], pairs[:, 1]], ["a", "b"])

    more = tasks.join(sets, "doc_id").groupBy("key", "one", "two").applyInArrow(compare, "a bigint, b bigint")
    return materialize(star.unionByName(more).distinct(), "near")


def later_copies(docs: DataFrame, **rules) -> DataFrame:
    """doc_id of all documents but the smallest id of each component of near copies."""
    return components(near_links(docs, **rules)).where("node <> component").select(F.col("node").alias("doc_id"))
