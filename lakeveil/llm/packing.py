"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised, ended with id 0, and cut into pieces of the sequence
length. Pieces are dealt into blocks of a bounded number, by hash. A block is
evolved on several islands at once. A chromosome is a grouping of the block's
pieces into bins; islands start from best-fit decreasing and from best fits of
shuffled parts. Crossover injects well-filled bins of one parent into another
as a whole, removes the bins that hold the same pieces, lets what is displaced
take the places of smaller pieces where that fills a bin better, and best-fits
the rest; mutation breaks up the emptiest bins. After each epoch an island's
elite migrates to the next island of its block. A block is done when it has as
few bins as a lower bound says it must; the best grouping of its islands is its
packing. At the end the emptiest bins of all blocks are broken up and
best-fitted once more, in groups of a bounded number of pieces.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common  # noqa: F401  functions travel by value
from .common import materialize, release, sliced

LENGTH = 2048


# The tokenizer's own rule for parts of words, for text of Latin letters.
LATIN_PARTS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+"
LATIN_TEXT = "[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*"


class Encoder:
    """text -> little-endian unsigned 32-bit ids, equal to the tokenizer's own.

    The tokenizer lower-cases, drops white space and merges inside parts of
    words, so a part's ids don't depend on its neighbours and are kept by part.
    Texts with characters outside ASCII and the Latin-1 letters, where parts
    follow other rules, go to the tokenizer as they are.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        plain, shown, extra = [*range(33, 127), *range(161, 173), *range(174, 256)], {}, 0
        for byte in range(256):
            shown[byte] = chr(byte if byte in plain else 256 + extra)
            extra += byte not in plain

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                found = model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(shown))
                if len(self) >= keep:
                    self.clear()
                out = self[part] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
                return out

        self.parts, self.split, self.latin = Parts(), re.compile(LATIN_PARTS).findall, re.compile(LATIN_TEXT).fullmatch
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self.verify()

    def verify(self) -> bool:
        """Whether keeping ids by part gives this tokenizer's ids; another tokenizer is simply called."""
        probe = "The naïve café's 42 façades, aren't it? ÀÉ ß-test... x'll THE  end\n\tA&&& b|c <d> Straße ''s"
        return self._plain(probe) == self._by_part(probe)

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _by_part(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.split(text.lower())))

    def __call__(self, text: str) -> bytes:
        if self.fast and self.latin(text) and not any(s in text for s in self.special):
            return self._by_part(text)
        return self._plain(text)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit); at least one row for each row."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for b in sliced(batches):
            rows, piece, start, size, ids = [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = encode(text or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    ids.append(part)
            doc = b.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary"
    )


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], room: list[int], most: int) -> None:
    """Put items, largest first, each into the open bin with the least room that takes it."""
    open_bins = sorted((r, k) for k, r in enumerate(room) if r)
    for i in sorted(items, key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(open_bins, (sizes[i], -1))
        if at < len(open_bins):
            r, k = open_bins.pop(at)
        else:
            r, k = most, len(bins)
            bins.append([])
            room.append(most)
        bins[k].append(i)
        room[k] = r - sizes[i]
        if room[k]:
            bisect.insort(open_bins, (room[k], k))


def least_bins(sizes: list[int], most: int) -> int:
    """A lower bound: for each size a up to half a bin, pieces over ``most - a`` are alone with any of a or more,
    others over half a bin need one each, and what pieces from a to half a bin don't find there needs more."""
    if not sizes:
        return 0
    s = np.sort(np.array(sizes, np.int64))
    upto, half = np.concatenate([[0], np.cumsum(s)]), int(np.searchsorted(s, most // 2, "right"))
    small = np.unique(s[:half])
    big = len(s) - np.searchsorted(s, most - small, "right")
    wide = len(s) - big
    free = (wide - half) * most - (upto[wide] - upto[half])
    rest = upto[half] - upto[np.searchsorted(s, small, "left")]
    found = big + wide - half + np.maximum(0, -(-(rest - free) // most))
    return max(-(-int(s.sum()) // most), len(s) - half, int(found.max(initial=0)))


def filled(sizes: list[int], piece_ids: list[int]) -> int:
    return sum([sizes[i] for i in piece_ids])


def fitness(sizes: list[int], bins: list[list[int]], most: int) -> tuple[int, float]:
    """Fewer bins first; among equals, fuller bins (a sum of squared fill) are better to build on."""
    return -len(bins), sum([(filled(sizes, b) / most) ** 2 for b in bins])


def swap_in(sizes: list[int], loose: list[int], bins: list[list[int]], room: list[int], rng: random.Random) -> list[int]:
    """Put a loose piece in the place of one or two smaller ones of a bin, where that fills it best; what is loose afterwards."""
    order = sorted(loose, key=lambda i: (sizes[i], i))
    values = [sizes[i] for i in order]
    open_bins = [k for k, r in enumerate(room) if r]
    rng.shuffle(open_bins)
    for k in open_bins:
        if not order:
            break
        held, gain, swap = bins[k], 0, None
        for x in range(len(held)):
            for y in range(-1, x):
                out = (held[x],) if y < 0 else (held[x], held[y])
                freed = filled(sizes, out)
                at = bisect.bisect_right(values, freed + room[k]) - 1
                if at >= 0 and values[at] - freed > gain:
                    gain, swap = values[at] - freed, (out, at)
        if swap:
            out, at = swap
            bins[k] = [i for i in held if i not in out] + [order.pop(at)]
            values.pop(at)
            room[k] -= gain
            for i in out:
                at = bisect.bisect_left(values, sizes[i])
                values.insert(at, sizes[i])
                order.insert(at, i)
    return order


def settle(sizes: list[int], bins: list[list[int]], loose: list[int], most: int, rng: random.Random, swaps: bool = True) -> list[list[int]]:
    bins = [list(b) for b in bins]
    room = [most - filled(sizes, b) for b in bins]
    best_fit(sizes, swap_in(sizes, loose, bins, room, rng) if swaps else loose, bins, room, most)
    return bins


def crossover(sizes: list[int], one: list[list[int]], two: list[list[int]], most: int, rng: random.Random, swaps: bool = True) -> list[list[int]]:
    """``one`` with some of the best-filled bins of ``two`` injected."""
    full = sorted(two, key=lambda b: -filled(sizes, b))[: max(1, len(two) // 2)]
    take = rng.sample(full, max(1, len(full) // 3))
    injected = {i for b in take for i in b}
    kept, loose = [], []
    for b in one:
        if injected.isdisjoint(b):
            kept.append(b)
        else:
            loose += [i for i in b if i not in injected]
    return settle(sizes, take + kept, loose, most, rng, swaps)


def mutate(sizes: list[int], bins: list[list[int]], most: int, rng: random.Random) -> list[list[int]]:
    """Break up the emptiest bins and as many others, and place what they held anew."""
    order = sorted(range(len(bins)), key=lambda k: filled(sizes, bins[k]))
    few = max(1, len(bins) // 20)
    gone = set(order[:few]) | set(rng.sample(order, min(len(order), few)))
    return settle(sizes, [b for k, b in enumerate(bins) if k not in gone], [i for k in sorted(gone) for i in bins[k]], most, rng)


def start_population(sizes: list[int], most: int, seed: int, people: int) -> list[list[list[int]]]:
    rng, out = random.Random(seed), []
    for k in range(people):
        bins: list[list[int]] = []
        room: list[int] = []
        items = list(range(len(sizes)))
        if k:  # all but the first are best-fitted in shuffled parts
            rng.shuffle(items)
            half = len(items) // (k + 1)
            best_fit(sizes, items[:half], bins, room, most)
            items = items[half:]
        best_fit(sizes, items, bins, room, most)
        out.append(bins)
    return out


def evolve(sizes: list[int], population: list[list[list[int]]], most: int, seed: int, rounds: int, mutation: bool = True, swaps: bool = True) -> list[list[list[int]]]:
    """Steady-state rounds, best first; ends early when the lower bound of bins is reached."""
    rng, bound = random.Random(seed), least_bins(sizes, most)
    ranked = sorted(((fitness(sizes, b, most), b) for b in population), key=lambda x: x[0], reverse=True)
    for n in range(rounds):
        if not ranked or -ranked[0][0][0] <= bound:
            break
        a, b = rng.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
        child = crossover(sizes, ranked[min(a, b)][1], ranked[max(a, b)][1], most, rng, swaps)
        if mutation and n % 2:
            child = mutate(sizes, child, most, rng)
        score = fitness(sizes, child, most)
        if score > ranked[-1][0] and all(score != x for x, _ in ranked):  # no twins
            ranked[-1] = (score, child)
            ranked.sort(key=lambda x: x[0], reverse=True)
    return [b for _, b in ranked]


def _flat(bins: list[list[int]]) -> list[int]:
    """Bin of each piece."""
    out = [0] * sum(map(len, bins))
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return [b for b in out if b]


def pack_pieces(pieces: DataFrame, most: int = LENGTH, block: int = 1024, islands: int = 2, people: int = 8, rounds: int = 60, epochs: int = 3, merged: int = 8192, seed: int = 11) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length (0 < length <= most).

    Pieces of full length are sequences of their own. The rest is dealt into
    blocks of about ``block`` pieces, whatever the table's size. Repeated rows
    are pieces of their own. An empty table gives no rows. ``pid`` is added for
    the work, and no column of ``pieces`` may have that name.
    """
    columns = pieces.columns
    kept = materialize(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    total = kept.where(F.col("length") < most).count()
    blocks = max(1, math.ceil(total / block))
    short = kept.where(F.col("length") < most).select(
        F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"), "pid", F.col("length").cast("int").alias("size")
    )
    schema = "block int, island int, pids array<bigint>, sizes array<int>, people array<array<int>>, n_bins int, done boolean"

    def row(key, epoch: int, pids: list[int], sizes: list[int], population: list[list[list[int]]]) -> pa.Table:
        block_id, island = key[0].as_py(), key[1].as_py()
        now = evolve(sizes, population, most, seed + 31 * block_id + island + 977 * epoch, rounds)
        done = len(now[0]) <= least_bins(sizes, most)
        flat = [_flat(x) for x in (now[:1] if done or epoch + 1 == epochs else now)]
        return pa.table(
            {
                "block": pa.array([block_id], pa.int32()),
                "island": pa.array([island], pa.int32()),
                "pids": pa.array([pids], pa.list_(pa.int64())),
                "sizes": pa.array([sizes], pa.list_(pa.int32())),
                "people": pa.array([flat], pa.list_(pa.list_(pa.int32()))),
                "n_bins": pa.array([len(now[0])], pa.int32()),
                "done": pa.array([done], pa.bool_()),
            }
        )

    def first_epoch(key, rows):
        rows = rows.sort_by("pid")
        pids, sizes = rows.column("pid").to_pylist(), rows.column("size").to_pylist()
        return row(key, 0, pids, sizes, start_population(sizes, most, seed * 1000 + key[1].as_py(), people))

    def next_epoch(epoch: int):
        def run(key, rows):
            """An island's people and, in place of the last of them, the elite that came from its neighbour."""
            rows = rows.sort_by("came")
            pids, sizes = rows.column("pids")[0].as_py(), rows.column("sizes")[0].as_py()
            own, guests = rows.column("people")[0].as_py(), rows.column("people").to_pylist()[1:]
            now = own[: max(1, people - len(guests))] + [g[0] for g in guests]
            return row(key, epoch, pids, sizes, [_bins(x) for x in now])

        return run

    spread = short.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = materialize(spread.groupBy("block", "island").applyInArrow(first_epoch, schema), "epoch0")
    for epoch in range(1, epochs):
        open_blocks = state.groupBy("block").agg(F.max("done").alias("any")).where("not any").select("block")
        if open_blocks.isEmpty():
            break
        unsettled = state.join(open_blocks, "block", "left_semi")
        guests = unsettled.withColumn("island", (F.col("island") + 1) % islands).withColumn("people", F.slice("people", 1, 1))
        both = unsettled.withColumn("came", F.lit(False)).unionByName(guests.withColumn("came", F.lit(True)))
        evolved = both.groupBy("block", "island").applyInArrow(next_epoch(epoch), schema)
        last, state = state, materialize(state.join(open_blocks, "block", "left_anti").unionByName(evolved), f"epoch{epoch}")
        release(last)
    best = state.groupBy("block").agg(F.min_by(F.struct("pids", "sizes", F.col("people")[0].alias("bins")), F.struct("n_bins", "island")).alias("best"))
    placed = materialize(
        best.select("block", F.explode(F.arrays_zip("best.pids", "best.sizes", "best.bins")).alias("x")).select(
            "block", F.col("x.pids").alias("pid"), F.col("x.sizes").alias("size"), F.col("x.bins").alias("bin")
        ),
        "placed",
    )
    release(state)

    def merge(key, rows):
        """Some of the emptiest bins, broken up and best-fitted together."""
        rows = rows.sort_by("pid")
        sizes, bins, room = rows.column("size").to_pylist(), [], []
        best_fit(sizes, list(range(len(sizes))), bins, room, most)
        was = len(set(zip(rows.column("block").to_pylist(), rows.column("bin").to_pylist(), strict=True)))
        if len(bins) > was:
            return rows.select(["pid", "size", "block", "bin"])
        group = -1 - key[0].as_py()
        return pa.table({"pid": rows.column("pid"), "size": rows.column("size"), "block": pa.array([group] * len(sizes), pa.int32()), "bin": pa.array(_flat(bins), pa.int32())})

    each = placed.groupBy("block", "bin").agg(F.sum("size").alias("filled"), F.count("*").alias("n"))
    loose = materialize(each.where(F.col("filled") < most * 0.9).select("block", "bin", "n"), "loose")
    groups = max(1, math.ceil((loose.agg(F.sum("n")).first()[0] or 0) / merged))
    loose = loose.select("block", "bin", F.pmod(F.xxhash64("block", "bin"), F.lit(groups)).cast("int").alias("group"))
    marked = placed.join(loose, ["block", "bin"], "left")
    again = marked.where("group is not null").groupBy("group").applyInArrow(merge, "pid bigint, size int, block int, bin int")
    at = marked.where("group is null").select("pid", "size", "block", "bin").unionByName(again)
    from pyspark.sql import Window

    order = Window.partitionBy("block", "bin").orderBy("pid")
    seated = at.withColumn("offset", (F.sum("size").over(order) - F.col("size")).cast("bigint")).select(
        F.col("pid").alias("p"), (F.col("block").cast("bigint") * (1 << 32) + F.col("bin") * 2).alias("sequence_id"), "offset"
    )
    whole = kept.where(F.col("length") >= most).select(*columns, (F.col("pid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    part = kept.where(F.col("length") < most).join(seated, F.col("pid") == F.col("p")).select(*columns, "sequence_id", "offset")
    return whole.unionByName(part)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from rows with ids. A sequence has one piece for each place; an empty table gives no rows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(F.transform(parts, lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **how) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and then id 0; only documents longer than ``length``
    are cut. A null text counts as empty and is the one id 0. Repeated rows are
    packed each for itself. An empty table gives no rows; other columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, length, id_col=id_col, text_col=text_col)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    pieces = pieces if with_ids else pieces.drop("ids")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return pack_pieces(pieces, length, **how).select(*out)
