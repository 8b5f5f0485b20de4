"""SimHash near-duplicates with Golay-code fuzzy hashing.

A document's 64-bit fingerprint is the majority of its shingles' XXH64 bits.
Fingerprints that differ in up to 4 bits are linked and documents get the id of
their component. Search works on distinct fingerprints only:

1. A fingerprint is cut into segments A, B, C of 22, 21 and 21 bits. Each is
   decoded to the indices of the Golay codewords near it (see ``golay``).
   ``all`` covers 2 errors; ``own`` against ``all`` covers 1.
2. Pigeonhole for at most 4 errors over A, B, C. If a segment i has none, then
   of the others j, k either j has up to 2 (key: exact i, all j) or k has at
   most 1 (key: exact i, all k). If every segment has one, at least two have
   exactly 1, and for one of the three pairs i, j the keys (own i, all j) and
   (all i, own j) meet. So each pair within 4 bits shares a key.
3. Fingerprints are sorted by key; inside a key they are compared by their bits.
   What a key sends on is a spanning forest of its links, not all pairs, so the
   output is linear in the rows, and components keep every link's effect.
   A key with more fingerprints than ``block`` is cut into blocks, and pairs of
   blocks are compared as tasks of their own.
4. Components by repeated minimum over neighbours with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from .common import materialize
from .components import components

WIDTHS = (22, 21, 21)
SHIFTS = (42, 21, 0)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned. ``bytes.lower`` and ``bytes.split`` are the ASCII rules wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_digest, len(stops)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, fp (signed), one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def search_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, index into fps) for every key of every fingerprint; repeats of a key in one fingerprint are dropped."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(SHIFTS, WIDTHS, strict=True)]
    own, near = zip(*(golay.keys(s) for s in seg), strict=True)
    out = []
    for i in range(3):
        for j in range(3):
            if i != j:
                out.append((np.int64(i * 3 + j) << 40) | (seg[i][:, None] << 12) | near[j])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        base = np.int64(9 + i + j) << 40
        out += [base | (own[i][:, None] << 12) | near[j], base | (near[i] << 12) | own[j][:, None]]
    table = np.sort(np.concatenate(out, axis=1), axis=1)
    fresh = np.ones(table.shape, bool)
    fresh[:, 1:] = table[:, 1:] != table[:, :-1]
    at, _ = np.nonzero(fresh)
    return table[fresh], at


def forest(fps: np.ndarray, ids: np.ndarray, most: int, other: np.ndarray | None = None, other_ids: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what differs in at most ``most`` bits: within fps, or between fps and other."""
    within = other is None
    right, right_ids, base = (fps, ids, 0) if within else (other, other_ids, len(fps))
    label, out = np.arange(base + len(right)), []
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count((right ^ fps[i]).view(np.uint64)) <= most)
        marks = label[near + base]
        for m in np.unique(marks[marks != label[i]]):
            j = near[np.argmax(marks == m)]
            out.append((int(ids[i]), int(right_ids[j])))
            label[label == m] = label[i]
    return out


def near_links(prints: DataFrame, most: int = 4, block: int = 2048) -> DataFrame:
    """a, b (representative ids) whose components are those of all links. ``prints``: fp, rep."""
    if most > 4:
        raise ValueError("the search keys find all pairs within 4 bits, not more")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, reps = b.column("fp").to_numpy(zero_copy_only=False), b.column("rep").to_numpy(zero_copy_only=False)
            for s in range(0, len(fps), 20_000):
                key, at = search_keys(fps[s : s + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[s:][at]), pa.array(reps[s:][at])], ["key", "fp", "rep"])

    schema = "a bigint, b bigint, big_key bigint, fp bigint, rep bigint"

    def emit(links: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.unique(np.array(links, np.int64).reshape(-1, 2), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none], ["a", "b", "big_key", "fp", "rep"])

    def pass_on(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(fp), pa.array(rep)], ["a", "b", "big_key", "fp", "rep"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key. Holds one batch and at most ``block`` rows of an open key; rows of larger keys are passed on."""
        links: list[tuple[int, int]] = []
        held = [np.empty(0, np.int64)] * 3
        big: int | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")]
            if big is not None:
                n = int(np.searchsorted(now[0], big, "right"))
                if n:
                    yield pass_on(*[x[:n] for x in now])
                now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                big = None
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            tail = len(now[0]) - last
            for out in runs([x[:last] for x in now], links):
                yield out
            held = [x[last:] for x in now]
            if tail > block:
                big = int(held[0][0])
                yield pass_on(*held)
                held = [np.empty(0, np.int64)] * 3
            if len(links) > 100_000:
                yield emit(links)
                links.clear()
        for out in runs(held, links):
            yield out
        if links:
            yield emit(links)

    def runs(rows: list[np.ndarray], links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        key, fp, rep = rows
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        small = np.repeat(size <= 8, size)
        for lag in range(1, 8):
            if lag < len(key):
                hit = (key[lag:] == key[:-lag]) & small[lag:]
                hit[hit] = np.bitwise_count((fp[lag:][hit] ^ fp[:-lag][hit]).view(np.uint64)) <= most
                links += zip(rep[:-lag][hit].tolist(), rep[lag:][hit].tolist(), strict=True)
        for at in np.flatnonzero(size > 8):
            s = slice(edge[at], edge[at + 1])
            if size[at] > block:
                yield pass_on(key[s], fp[s], rep[s])
            else:
                links += forest(fp[s], rep[s], most)

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by group; a group is a pair of blocks of one key, at most about 4 * block rows."""
        held: dict[str, np.ndarray] | None = None
        names = ("big_key", "one", "two", "own", "fp", "rep")

        def solve(g: dict[str, np.ndarray]) -> list[tuple[int, int]]:
            edge = np.flatnonzero(np.concatenate([[True], (g["big_key"][1:] != g["big_key"][:-1]) | (g["one"][1:] != g["one"][:-1]) | (g["two"][1:] != g["two"][:-1]), [True]]))
            out = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                fp, rep, own = g["fp"][a:z], g["rep"][a:z], g["own"][a:z]
                if g["one"][a] == g["two"][a]:
                    out += forest(fp, rep, most)
                else:
                    first = own == g["one"][a]
                    out += forest(fp[first], rep[first], most, fp[~first], rep[~first])
            return out

        for b in batches:
            if not b.num_rows:
                continue
            now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in names}
            same = (now["big_key"] == now["big_key"][-1]) & (now["one"] == now["one"][-1]) & (now["two"] == now["two"][-1])
            last = int(np.argmax(same))
            if last and (links := solve({c: v[:last] for c, v in now.items()})):
                yield emit(links)
            held = {c: v[last:] for c, v in now.items()}
        if held is not None and (links := solve(held)):
            yield emit(links)

    keyed = prints.mapInArrow(expand, "key bigint, fp bigint, rep bigint")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, schema), "links")
    links = found.where("a is not null").select("a", "b")
    large = found.where("big_key is not null")
    if large.isEmpty():
        return links
    counts = large.groupBy("big_key").agg(F.expr(f"cast(ceil(count(1) / {block}) as int)").alias("blocks"))
    dealt = large.join(counts, "big_key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    paired = dealt.select("big_key", "own", "fp", "rep", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "big_key", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "fp", "rep"
    )
    grouped = paired.repartition("big_key", "one", "two").sortWithinPartitions("big_key", "one", "two")
    more = grouped.mapInArrow(compare_blocks, schema).select("a", "b")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, block: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row for each row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lower-cased; texts of
    fewer words than a shingle are one shingle, null and blank texts have the
    fingerprint zero and are linked like any other. ``component_id`` is the
    smallest doc_id reachable over links of at most ``most`` differing bits. A
    row with a null id keeps its own fingerprint and links nothing on: it gets
    the component of its fingerprint, null if no other row has an id there.
    Repeated rows share a component. An empty table gives no rows; other columns
    are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").cast("bigint").alias("rep")), "distinct")
    links = materialize(near_links(reps, most, block).distinct(), "near")
    merged = components(links)
    known = reps.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
