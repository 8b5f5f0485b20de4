"""Compressed vectors: one codebook for each part of the vector, trained by filtering Lloyd rounds.

Components become integers, so sums, means and distances are exact and don't
depend on how the rows are dealt.

1. Rows are packed in blocks of a partition. For each part of the vectors a
   block has a kd-tree: its points in the tree's order, in which every node is a
   range, so boxes, sums and counts of all nodes come from a few reductions. The
   trees are built once and written; all rounds read them.
2. A round sends the codebooks (a fixed number of integers) to all blocks. From
   the root down, a node keeps the entries that can be nearest to some point of
   its box: an entry goes if another is nearer, or as near and before it, at
   the corner that suits it best. A node with one entry left gives it the cached
   sum and count of the whole subtree; leaves compare their points with what is left.
3. Sums and counts are added up within a partition before they are shuffled, and
   over all partitions by Spark; the means come to the driver, as many integers
   as the codebooks have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sliced

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and points of a tree's leaf.
BLOCK, LEAF = 8192, 16
#: Integers up to this size have squared distances that fit 64 bits; larger ones are computed as Python's.
NARROW = 1 << 24
LONGEST = 2**63 - 1
LIMB = 32


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x): as 64-bit integers where all are small and as Python's integers where one is not."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors.astype(np.float64) * SCALE)
    if not x.size or np.abs(x).max() <= NARROW:
        return x.astype(np.int64)
    mantissa, power = np.frexp(vectors.astype(np.float64))  # 256 * x may be beyond a double
    whole = (mantissa * 2.0**53).astype(np.int64).astype(object)
    shift = power.astype(np.int64) - 53 + 8
    return np.frompyfunc(lambda m, s: m << s if s >= 0 else m >> min(-s, 64), 2, 1)(whole, shift)


def levels(n: int) -> int:
    """Halvings of n points until a node has LEAF points at most."""
    deep = 0
    while n > LEAF:
        n, deep = (n + 1) // 2, deep + 1
    return deep


def edges(n: int, deep: int) -> np.ndarray:
    """Where the nodes of a level begin, and n."""
    return (np.arange((1 << deep) + 1) * n) >> deep


def tree_order(points: np.ndarray) -> np.ndarray:
    """The points' numbers in the order of a kd-tree: each node is halved along its widest side, ties by number."""
    n, deep = len(points), levels(len(points))
    order = np.arange(n)
    for level in range(deep):
        at = edges(n, level)
        p = points[order]
        lo, hi = np.minimum.reduceat(p, at[:-1]), np.maximum.reduceat(p, at[:-1])
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        side = (hi - lo).argmax(axis=1)
        value = p[np.arange(n), side[node]]
        rank = np.empty(n, np.int64)
        rank[np.argsort(value, kind="stable")] = np.arange(n)
        order = order[np.lexsort((rank, node))]
    return order


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of ranges, one after the other."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _firsts(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each run of the given sizes has its first smallest value."""
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, start), sizes))
    return least[np.searchsorted(least, start)]


def filtered(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point, sums by entry, counts by entry); points in the order of their tree, equally near ones go to the first entry."""
    n, k = len(points), len(book)
    code, sums, counts = np.zeros(n, np.int64), np.zeros_like(book), np.zeros(k, np.int64)
    deep = levels(n)
    nodes, entry, left = np.zeros(1, np.int64), np.arange(k), np.array([k])  # the entries left, node by node, and their numbers
    for level in range(deep + 1):
        at = edges(n, level)
        lo, hi = (f.reduceat(points, at[:-1])[nodes] for f in (np.minimum, np.maximum))
        of = np.repeat(np.arange(len(nodes)), left)
        # the entry nearest to the middle of the box; all doubled, so that it stays whole
        best = entry[_firsts((((lo + hi)[of] - 2 * book[entry]) ** 2).sum(axis=1), left)][of]
        # an entry's distance less the best one's, at the corner of the box that suits the entry
        corner = np.where(book[entry] > book[best], hi[of], lo[of])
        less = ((corner - book[entry]) ** 2).sum(axis=1) - ((corner - book[best]) ** 2).sum(axis=1)
        stay = (less < 0) | ((less == 0) & (entry <= best))
        entry, left = entry[stay], np.bincount(of[stay], minlength=len(nodes))
        single = left == 1
        whole, own = nodes[single], entry[np.repeat(single, left)]
        if len(whole):
            sizes = np.diff(at)[whole]
            np.add.at(sums, own, np.add.reduceat(points, at[:-1])[whole])
            np.add.at(counts, own, sizes)
            code[_ranges(at[whole], sizes)] = np.repeat(own, sizes)
        entry, nodes, left = entry[np.repeat(~single, left)], nodes[~single], left[~single]
        if not len(nodes):
            return code, sums, counts
        if level < deep:  # both halves get what is left
            entry = entry[_ranges(np.repeat(np.cumsum(left) - left, 2), np.repeat(left, 2))]
            nodes, left = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(left, 2)
    sizes = np.diff(at)[nodes]
    rows, each = _ranges(at[nodes], sizes), np.repeat(left, sizes)
    tried = entry[_ranges(np.repeat(np.cumsum(left) - left, sizes), each)]
    own = tried[_firsts(((np.repeat(points[rows], each, axis=0) - book[tried]) ** 2).sum(axis=1), each)]
    code[rows] = own
    np.add.at(sums, own, points[rows])
    np.add.at(counts, own, 1)
    return code, sums, counts


def usable(vector: Column) -> Column:
    """Neither null nor empty nor with a null, infinite or undefined component."""
    x = lambda v: v.cast("double")
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))


def _blocks(rows: DataFrame, parts: int, dims: int) -> DataFrame:
    """ids, labels, wide, points, orders: blocks of vectors, by part in the order of its tree."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            own = pa.Table.from_batches(held)
            x = integers(np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for b in held]))
            wide = x.dtype == object
            points, orders = [], []
            for p in np.split(x, parts, axis=1):
                order = tree_order(p)
                orders.append(order.astype(np.uint16).tobytes())
                points.append(" ".join(map(str, p[order].ravel())).encode() if wide else p[order].astype(np.int32).tobytes())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column(c).combine_chunks()) for c in ("id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([wide]), pa.array([points], pa.list_(pa.binary())), pa.array([orders], pa.list_(pa.binary()))], ["ids", "labels", "wide", "points", "orders"])

        for b in sliced(batches, 1024):
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                yield block()
                held.clear()
        if sum(x.num_rows for x in held):
            yield block()

    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, wide boolean, points array<binary>, orders array<binary>")


def _points(wide: bool, raw: bytes, book: np.ndarray) -> np.ndarray:
    x = np.array([int(v) for v in raw.split()], object) if wide else np.frombuffer(raw, np.int32)
    return x.reshape(-1, book.shape[1]).astype(object if wide else book.dtype)


def _narrow(books: np.ndarray) -> np.ndarray:
    return books.astype(np.int64) if all(abs(v) <= NARROW for v in books.ravel().tolist()) else books


def _means(blocks: DataFrame, books: np.ndarray, limbs: int) -> np.ndarray:
    """New codebooks: of each entry the floor of its points' mean; the old entry where it has none.

    Sums travel as limbs of 32 bits, so that they are exact whatever the components are.
    """
    parts, k, width = books.shape
    names = [f"l{i}" for i in range(limbs)]
    now = _narrow(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(now.shape, object), np.zeros((parts, k), np.int64)
        for b in sliced(batches, 1):
            wide, points = b.column("wide")[0].as_py(), b.column("points")[0].as_py()
            for p in range(parts):
                book = now[p].astype(object) if wide else now[p]
                _, s, n = filtered(_points(wide, points[p], book), book)
                sums[p] += s
                counts[p] += n
        p, e = np.nonzero(counts)
        place = np.repeat((p * k + e) * width, width) + np.tile(np.arange(width), len(p))
        total = [int(v) for v in sums[p, e].ravel()]
        low = [pa.array([v >> LIMB * i & (1 << LIMB) - 1 for v in total], pa.int64()) for i in range(limbs - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.repeat(counts[p, e], width)), *low, pa.array([v >> LIMB * (limbs - 1) for v in total], pa.int64())], ["place", "n", *names])

    found = blocks.select("wide", "points").mapInArrow(run, f"place int, n bigint, {', '.join(f'{c} bigint' for c in names)}")
    out = books.ravel().copy()
    for r in found.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # as many as the codebooks have integers
        out[r.place] = sum(r[c] << LIMB * i for i, c in enumerate(names)) // r.n
    return out.reshape(books.shape)


def _encode(blocks: DataFrame, books: np.ndarray, id_kind: str, label_kind: str) -> DataFrame:
    """vec_id, label, code, error."""
    parts, now = len(books), _narrow(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            wide, points, orders = (b.column(c)[0].as_py() for c in ("wide", "points", "orders"))
            ids, labels = b.column("ids").flatten(), b.column("labels").flatten()
            codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), object)
            for p in range(parts):
                book = now[p].astype(object) if wide else now[p]
                x, order = _points(wide, points[p], book), np.frombuffer(orders[p], np.uint16)
                code = filtered(x, book)[0]
                codes[order, p] = code
                error[order] += ((x - book[code]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([min(int(e), LONGEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {id_kind}, label {label_kind}, code string, error bigint")


def codebooks(blocks: DataFrame, seeds: list, parts: int, rounds: int, limbs: int) -> np.ndarray:
    """(parts, entries, components) integers after the rounds, from the seeds' own parts."""
    x = integers(np.array(seeds, np.float64)).astype(object)
    books = np.stack(np.split(x, parts, axis=1))
    for _ in range(rounds):
        books = _means(blocks, books, limbs)
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label_error for each kept row; the codebooks).

    Rows go whose vector is null, empty, or has a null, infinite or undefined
    component; also those of another length than the kept row with the smallest
    id (a null id is after all others, equal ids are in the order of their
    vectors) among those that can be cut in ``parts``. Repeated rows each have
    their own code, and each is a seed where it is among the first. With fewer
    rows than entries there are as many entries as rows; a table without kept
    rows gives none, and no codebooks. Errors beyond 64 bits are the largest
    long. Null labels are one group; other columns are ignored.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    rows = rows.where(usable(F.col("vector")) & (F.size("vector") % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).select(F.size("vector").alias("dims")).first()
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    if first is None:
        nothing = rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")).limit(0)
        return nothing, np.zeros((parts, 0, 0), object)
    rows = rows.where(F.size("vector") == first.dims)
    seeds = [r.vector for r in rows.orderBy(*order).limit(entries).select("vector").collect()]
    blocks = materialize(_blocks(rows, parts, first.dims), "blocks")
    books = codebooks(blocks, seeds, parts, rounds, 6 if kind == "array<float>" else 34)
    coded = materialize(_encode(blocks, books, id_kind, label_kind), "codes")
    release(blocks)
    of_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    of_label = materialize(of_label.select("of", F.least("sum", F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "labels")
    out = coded.join(of_label, coded.label.eqNullSafe(of_label.of))
    return out.select("vec_id", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, code_col: str = "code") -> DataFrame:
    """``codes`` with ``vector``: the entries that a code names, as components again (to within a 256th and the quantisation)."""
    parts, k, width = books.shape
    table = F.array(*[F.array(*[F.lit(float(v) / SCALE) for v in books[p, e]]) for p in range(parts) for e in range(k)])
    entry = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*[F.get(table, p * k + entry(p)) for p in range(parts)])))
