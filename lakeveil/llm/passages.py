"""Substring deduplication by paragraph MinHash banding.

Paragraphs are of two kinds. The lines of a text that have ``LINE`` words or more
are compared as near copies: MinHash values of their 5-word shingles lie in
bands of ``ROWS``, as many as the wanted recall needs; lines that meet in a band
are verified by the exact Jaccard coefficient and clustered by connected
components (see ``minhash``). Passages that begin and end anywhere are found by
sliding paragraphs of ``WINDOW + GRAM - 1`` words, one after each word: a sliding
paragraph has one MinHash value, the least hash of its runs of ``GRAM`` words, and
neighbours mostly have the same, so a text keeps about one run in ``WINDOW / 2``
words. Texts that share as many words in a row as a sliding paragraph has share
that run for certain, so no such passage is missed.

A paragraph's first occurrence (smallest doc_id, then place) stays, later ones
are removed. Later paragraphs that touch, or that a short edited stretch parts
in both texts alike, are one passage. Its edges are then moved outward word by
word for as long as it agrees with the first occurrence, in rounds of more and
more words, so what counts is the length of the shared passage, not where its runs stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import batches_of, materialize, release, sift, unwrapped, word_array, wrapped
from .components import contracted
from .hashes import Words, hashed_words, mix, shingled, tune_bands

SHINGLE, LINE, ROWS = 5, 20, 3
#: Words of a run, and runs of a sliding paragraph.
GRAM, WINDOW = 8, 13
#: Words by which a passage's edges are moved in the first round, and most words of an edited stretch inside one.
REACH, GAP = 32, 16
#: Bytes of texts that are worked on at a time; a longer text is alone.
BYTES = 1_000_000
#: Sliding paragraphs that are looked at together, and surrounding words that are sent together.
STRETCH, SENT = 1 << 20, 1 << 20
#: Bytes of the Arrow batches between Spark and Python.
BATCH = "4m"
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, as far as they were asked for."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.made = [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.made[0]) < n:
            self.made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, b, np.uint64)]), dtype=np.uint64) for b in self.bases]
        return self.made


def contents(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the words from start to end, alike wherever they stand."""
    up, down = powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + mix((end - start).astype(np.uint64)))


def sliding(x: np.ndarray, size: int, take: np.ufunc) -> np.ndarray:
    """The least or greatest (``take``) of each ``size`` neighbours, by doubling."""
    n, width = len(x) - size + 1, 1
    while 2 * width <= size:
        x, width = take(x[:-width], x[width:]), 2 * width
    return take(x[:n], x[size - width : size - width + n]) if size > width else x


def least_of_windows(x: np.ndarray, size: int, within: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct places that hold the least of a window of ``size``, of equal ones in it the first; ``within`` tells which windows count.

    A place holds the least of some window where the greatest minimum of its
    windows is its own value. Two equal ones in one window are found side by side;
    the second of them counts only for windows that begin after the first.
    """
    low = sliding(x, size, np.minimum)
    if within is not None:
        low = np.where(within, low, np.zeros(1, x.dtype))
    none = np.zeros(size - 1, x.dtype)
    found = np.flatnonzero(sliding(np.concatenate([none, low, none]), size, np.maximum) == x)
    again = np.flatnonzero((x[found[1:]] == x[found[:-1]]) & (np.diff(found) < size)) + 1
    place, first = found[again], np.zeros(len(again), bool)
    for k in range(size if len(again) else 0):
        at = place - k
        first |= (at > found[again - 1]) & (at < len(low)) & (low[np.clip(at, 0, len(low) - 1)] == x[place])
    return np.delete(found, again[~first])


def chosen(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the runs of ``GRAM`` words begin that are the least of a sliding paragraph of a text; texts lie between start and end, with words between them.

    Of equal runs the first counts; where all are equal (one word again and
    again) every ``WINDOW``th is enough.
    """
    long = end - start >= GRAM + WINDOW - 1
    if not long.any():
        return np.zeros(0, np.int64)
    gram = shingled(h, GRAM)
    edges = np.zeros(len(gram) - WINDOW + 2, np.int8)
    edges[start[long]], edges[end[long] - GRAM - WINDOW + 2] = 1, -1
    within = np.cumsum(edges[:-1], dtype=np.int8) > 0  # windows that lie in one text
    least: list[np.ndarray] = []
    for at in range(0, len(within), STRETCH):  # a long text in stretches, which overlap by a paragraph
        found = least_of_windows(gram[at : at + STRETCH + WINDOW - 1], WINDOW, within[at : at + STRETCH]) + at
        value = gram[found]
        same = np.concatenate([[False], (value[1:] == value[:-1]) & (np.diff(found) == 1)])[: len(found)]
        run = np.flatnonzero(~same)
        nth = np.arange(len(found)) - np.repeat(run, np.diff(np.append(run, len(found))))
        least.append(found[nth % WINDOW == 0])
    return np.unique(np.concatenate(least))


def by_bytes(batches: Iterator[pa.RecordBatch], most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of texts of ``most`` bytes, or of one text that has more."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at, mass = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and mass + n > most:
                yield b.slice(at, i - at)
                at, mass = i, 0
            mass += n
        if b.num_rows > at:
            yield b.slice(at)


_LISTS = {"p_start": "int", "p_words": "int", "p_key": "bigint", "p_content": "bigint", "l_start": "int", "l_words": "int", "l_content": "bigint", "l_keys": "bigint"}


def _paragraphs(texts: DataFrame, bands: int) -> DataFrame:
    """doc_id, text_hash, total (words), and the runs and long lines of each text as lists; ``l_keys`` has ``bands`` keys a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, none = [Powers(b) for b in BASES], Words().of([b""])
        kinds = {"int": np.int32, "bigint": np.int64}
        for b in by_bytes(batches):  # texts are laid one after the other, with words between them that belong to none
            words, at, edge, data = hashed_words(b.column("text"))
            n = np.searchsorted(at, edge)
            apart = SHINGLE * np.arange(b.num_rows)
            s, e, text = n[:-1] + apart, n[1:] + apart, np.repeat(np.arange(b.num_rows), np.diff(n))
            h = np.repeat(none, len(words) + SHINGLE * b.num_rows)
            h[np.arange(len(words)) + apart[text]] = words
            of = lambda x: np.searchsorted(s, x, "right") - 1  # noqa: E731, B023  the text of a place
            ps = chosen(h, s, e)
            pe = ps + GRAM
            ends = np.flatnonzero(data == 10)
            ls, le = (np.searchsorted(at, np.sort(np.concatenate(x))) for x in ([edge[:-1], ends + 1], [ends, edge[1:]]))
            keep = le - ls >= LINE
            ls, le = ls[keep], le[keep]
            ls, le = ls + apart[text[ls]], le + apart[text[ls]]
            keys = np.empty((len(ls), bands), np.uint64)
            if len(ls):
                grams, inside = shingled(h, SHINGLE), np.stack([ls, le - SHINGLE + 1], axis=1).ravel()
                for band in range(bands):
                    key = np.full(len(ls), band + 1, np.uint64)
                    for k in range(ROWS):
                        low = np.minimum.reduceat(mix(grams ^ np.uint64(0x1000193 * (2 * (band * ROWS + k) + 1))), inside)[::2]
                        key = mix(key * np.uint64(31) + low)
                    keys[:, band] = key
            own = {
                "p_start": ps - s[of(ps)], "p_words": pe - ps, "p_key": contents(h, ps, pe, powers[0]).view(np.int64), "p_content": contents(h, ps, pe, powers[1]).view(np.int64),
                "l_start": ls - s[of(ls)], "l_words": le - ls, "l_content": contents(h, ls, le, powers[1]).view(np.int64), "l_keys": keys.ravel().view(np.int64),
            }
            counts = {"p": np.bincount(of(ps), minlength=len(s)), "l": np.bincount(of(ls), minlength=len(s))}
            lists = []
            for c, kind in _LISTS.items():
                edges = np.concatenate([[0], np.cumsum(counts[c[0]] * (bands if c == "l_keys" else 1))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(own[c].astype(kinds[kind]))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array((e - s).astype(np.int32)), *lists], ["doc_id", "text_hash", "total", *_LISTS])

    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, total int, " + ", ".join(f"{c} array<{t}>" for c, t in _LISTS.items()))


def _line_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id (a line's content), shingles (distinct, sorted) of the wanted (doc_id, text_hash, start, words, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            h, at, edge, _ = hashed_words(b.column("text"))
            out, sets = [], []
            for first, lines in zip(np.searchsorted(at, edge[:-1]).tolist(), b.column("wanted").to_pylist(), strict=True):
                for w in lines:
                    out.append(w["content"])
                    start = first + w["start"]
                    sets.append(np.unique(shingled(h[start : start + w["words"]], SHINGLE)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return _asked(texts, wanted, "start", "words", "content").mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _asked(texts: DataFrame, wanted: DataFrame, *what: str) -> DataFrame:
    """doc_id, text_hash, text, wanted: the texts that something is asked of, with the list of what."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*what)).alias("wanted"))
    lists = materialize(lists, "asked")
    some = sift(texts, F.col("text_hash"), lists, "text_hash")
    return some.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "wanted")


def _surroundings(texts: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """doc_id, text_hash, place, left, right: hashes of up to ``reach`` words before and after a place, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            words, at, edge, _ = hashed_words(b.column("text"))
            h = (words >> np.uint64(32)).astype(np.uint32).view(np.int32)  # they only move edges
            n, asked = np.searchsorted(at, edge), b.column("wanted")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(asked).to_numpy())
            place = asked.flatten().field("place").to_numpy()
            here = n[row] + place
            left, right = np.minimum(place, reach), np.minimum(n[row + 1] - here, reach)
            part = np.cumsum(left + right) // SENT
            for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(part)) + 1):
                lists = []
                for size, begin, step in ((left[some], here[some] - 1, -1), (right[some], here[some], 1)):
                    edges = np.concatenate([[0], np.cumsum(size)])
                    values = h[np.repeat(begin, size) + step * (np.arange(edges[-1]) - np.repeat(edges[:-1], size))]
                    lists.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values)))
                pick = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pick), b.column("text_hash").take(pick), pa.array(place[some], pa.int32()), *lists], ["doc_id", "text_hash", "place", "left", "right"])

    return _asked(texts, wanted, "place").mapInArrow(run, "doc_id bigint, text_hash bigint, place int, left array<int>, right array<int>")


def _agreeing(mine: Column, other: Column) -> Column:
    """Length of the common beginning of two lists."""
    n = F.least(F.size(mine), F.size(other))
    differs = F.transform(F.arrays_zip(mine.alias("a"), other.alias("b")), lambda x: F.coalesce(x["a"] != x["b"], F.lit(True)))
    at = F.array_position(differs, True)
    return F.coalesce(F.when(at > 0, (at - 1).cast("int")).otherwise(n), F.lit(0))


def _merged(spans: DataFrame, gap: int, *same: Column) -> DataFrame:
    """Adds ``run``: spans (doc_id, text_hash, start, end) of a text that touch, or lie ``gap`` words apart where all of ``same`` hold for a span and the one before."""
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    apart = F.col("start") - F.max("end").over(before)
    near = F.lit(gap > 0)
    for s in same:
        near = near & s
    joined = (apart <= 0) | ((apart <= gap) & near)
    return spans.withColumn("fresh", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(by)).drop("fresh")


def _widened(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with before and after, the words by which their edges can be moved outward while they agree with the first occurrence.

    A round compares ``REACH`` words on each side, the next one eight times as many; runs
    that agree in all of them go on. An edge stops where a run that stands to the
    same first occurrence in the same way begins, as that one goes on from there.
    It stops a sliding paragraph after the next run that stands otherwise to the
    same text (as in a text of one word), since what goes on further has a run of its own.
    So a text's words are compared once for each way in which its runs stand.
    """
    zero, reach, further = F.lit(0).cast("int"), REACH, GRAM + WINDOW - 1
    beside = lambda side, *more: Window.partitionBy("doc_id", "text_hash", f"{side}_doc", f"{side}_hash", *more).orderBy("start", "end")
    stands = lambda side, at: beside(side, F.col(f"{side}_at") - F.col(at))
    limits = {
        "lo_limit": F.greatest(zero, F.coalesce(F.lag("end").over(stands("l", "start")), zero), F.coalesce(F.lag("start").over(beside("l")) - further, zero)),
        "hi_limit": F.least("total", F.coalesce(F.lead("start").over(stands("r", "end")), F.col("total")), F.coalesce(F.lead("end").over(beside("r")) + further, F.col("total"))),
    }
    now, done = materialize(runs.withColumns(limits).withColumns({"before": zero, "after": zero, "left_open": F.lit(True), "right_open": F.lit(True)}), "limits"), None
    while True:
        lo, its_lo, hi, its_hi = F.col("start") - F.col("before"), F.col("l_at") - F.col("before"), F.col("end") + F.col("after"), F.col("r_at") + F.col("after")
        now = now.withColumns({"lo": lo, "its_lo": its_lo, "hi": hi, "its_hi": its_hi})
        ask = lambda d, h, at: F.struct(F.col(d).alias("doc_id"), F.col(h).alias("text_hash"), F.col(at).cast("int").alias("place"))
        to_left, to_right = F.col("left_open") & (F.col("lo") > F.col("lo_limit")) & (F.col("its_lo") > 0), F.col("right_open") & (F.col("hi") < F.col("hi_limit"))
        sides = [F.when(to_left, ask("doc_id", "text_hash", "lo")), F.when(to_left, ask("l_doc", "l_hash", "its_lo")), F.when(to_right, ask("doc_id", "text_hash", "hi")), F.when(to_right, ask("r_doc", "r_hash", "its_hi"))]
        places = F.filter(F.array(*sides), lambda x: x.isNotNull())
        around = materialize(_surroundings(texts, now.select(F.explode(places).alias("x")).select("x.*").distinct(), reach), "around")

        def beside(rows: DataFrame, d: str, h: str, at: str, side: str, name: str) -> DataFrame:
            words = around.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("place").alias("_p"), F.col(side).alias(name))  # noqa: B023
            return rows.join(words, (F.col(d) == F.col("_d")) & (F.col(h) == F.col("_h")) & (F.col(at) == F.col("_p")), "left").drop("_d", "_h", "_p")

        met = beside(beside(now, "doc_id", "text_hash", "lo", "left", "my_left"), "l_doc", "l_hash", "its_lo", "left", "its_left")
        met = beside(beside(met, "doc_id", "text_hash", "hi", "right", "my_right"), "r_doc", "r_hash", "its_hi", "right", "its_right")
        left = F.when(to_left, _agreeing(F.col("my_left"), F.col("its_left"))).otherwise(0)
        right = F.when(to_right, _agreeing(F.col("my_right"), F.col("its_right"))).otherwise(0)
        met = met.withColumns({"more_left": left, "more_right": right}).drop("my_left", "its_left", "my_right", "its_right", "lo", "its_lo", "hi", "its_hi")
        before, after = F.col("before") + F.col("more_left"), F.col("after") + F.col("more_right")
        met = met.withColumns({"before": F.least(before, F.greatest(F.lit(0), F.col("start") - F.col("lo_limit"))), "after": F.least(after, F.greatest(F.lit(0), F.col("hi_limit") - F.col("end"))), "left_open": (F.col("more_left") >= reach) & (F.col("start") - before > F.col("lo_limit")), "right_open": (F.col("more_right") >= reach) & (F.col("end") + after < F.col("hi_limit"))})
        met = materialize(met.drop("more_left", "more_right"), "moved")
        release(around)
        ended = met.where("not left_open and not right_open").drop("left_open", "right_open", "lo_limit", "hi_limit")
        done = ended if done is None else done.unionByName(ended)
        now = met.where("left_open or right_open")
        if now.isEmpty():
            return done
        reach *= 8


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.97, min_words: int = GRAM + WINDOW - 1, block: int = 256
) -> DataFrame:
    """A row for each passage that other documents have too: doc_id, start_word, n_words, first_doc_id, n_removed, text_hash.

    ``start_word`` counts words (runs of anything but ASCII white space) from 0;
    ``text_hash`` is ``xxhash64`` of the text, which tells rows that share an id
    apart. A later passage has ``n_removed = n_words``, and in ``first_doc_id`` the
    smallest id with a first occurrence of one of its paragraphs; the passages of
    first occurrences have ``n_removed = 0`` and their own id. Passages of fewer than
    ``min_words`` words are left alone, as are first ones inside a later one. What is repeated only inside rows of one
    id is no repeat, so repeated rows don't count against each other. Rows with
    a null id or text and texts of fewer than five words take no part. Ties in
    place can't occur. An empty table gives no rows; other columns are ignored.
    Every passage of ``min_words`` words that are the same is found (tested from
    20 words up). One with changed words is found by its unchanged stretches of so
    many words, which a similarity of 0.8 leaves in passages of 50 words or more,
    and is one passage where changed stretches have ``GAP`` words at most; lines
    at the similarity are found with a recall of over 0.95 against all pairs.
    """
    with batches_of(docs.sparkSession, BATCH):
        return _found(docs, id_col, text_col, similarity, recall, min_words, block)


def _found(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float, min_words: int, block: int) -> DataFrame:
    bands, once = tune_bands(similarity, recall, ROWS), ["doc_id", "text_hash"]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    units = materialize(_paragraphs(texts.select("doc_id", "text_hash", "text"), bands), "paragraphs")
    if not units.groupBy(*once).count().where("count > 1").isEmpty():  # repeated rows count once
        texts, more = materialize(texts.dropDuplicates(once), "texts"), units
        units = materialize(units.dropDuplicates(once), "paragraphs")
        release(more)
    keys = units.select("doc_id", F.explode(F.concat("p_key", "l_keys")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("key")
    shared = materialize(shared, "shared")

    # runs: all words agree, in two independent hashes; of those that the sieve lets through by chance no first one is left
    pieces = units.select("doc_id", "text_hash", "total", F.inline(F.arrays_zip("p_start", "p_words", "p_key", "p_content"))).withColumnsRenamed(
        {"p_start": "start", "p_words": "words", "p_key": "key", "p_content": "content"}
    )
    pieces = materialize(sift(pieces, F.col("key"), shared, "key"), "pieces")
    place = F.struct("doc_id", "text_hash", "start", "words")
    firsts = pieces.groupBy("key", "content").agg(F.min(place).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last").drop("last")
    members = pieces.join(materialize(firsts, "firsts"), ["key", "content"]).select("doc_id", "text_hash", "total", "start", "words", "first")

    # lines: those that meet in a band, by their content
    lines = units.where("size(l_start) > 0").select("doc_id", "text_hash", "total", "l_keys", F.posexplode(F.arrays_zip("l_start", "l_words", "l_content")).alias("i", "line"))
    met = lines.select(F.col("line.l_content").alias("doc_id"), F.explode(F.slice("l_keys", F.col("i") * bands + 1, F.lit(bands))).alias("key"))
    rows = materialize(sift(met, F.col("key"), shared, "key").join(shared, "key", "left_semi").distinct(), "bands")
    contents = materialize(rows.select(F.col("doc_id").alias("content")).distinct(), "contents")
    lines = lines.select("doc_id", "text_hash", "total", F.col("line.l_start").alias("start"), F.col("line.l_words").alias("words"), F.col("line.l_content").alias("content"))
    held = materialize(sift(lines, F.col("content"), contents, "content").join(contents, "content", "left_semi"), "held")
    one = held.groupBy("content").agg(F.min(F.struct("doc_id", "text_hash", "start", "words")).alias("at"))
    links = minhash.linked(rows, lambda ids: _line_sets(texts, one.join(ids.withColumnRenamed("doc_id", "content"), "content", "left_semi").select("at.*", "content")), similarity, block, contracted)
    groups = contracted(links).withColumnsRenamed({"node": "content", "component": "group"})
    held = materialize(held.join(groups, "content", "left").withColumn("group", F.coalesce("group", "content")), "grouped")
    firsts = held.groupBy("group").agg(F.min(place).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id <> last").drop("last")
    near = held.join(materialize(firsts, "firsts"), "group").select("doc_id", "text_hash", "total", "start", "words", "first")

    later = members.unionByName(near).where(place != F.col("first")).withColumn("end", F.col("start") + F.col("words"))
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    same_first = F.lag("first.doc_id").over(by) == F.col("first.doc_id")
    shift = lambda f, at: f.getField("start") - at
    alike = F.abs(shift(F.lag("first").over(by), F.lag("start").over(by)) - shift(F.col("first"), F.col("start"))) <= 3
    marked = materialize(_merged(later, GAP, same_first, alike), "marked")
    runs = marked.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("total").alias("total"),
        F.min("first.doc_id").alias("first_doc_id"), F.min_by("first", F.struct("start", "end")).alias("l"), F.max_by("first", F.struct("end", "start")).alias("r"),
    )
    runs = runs.select("doc_id", "text_hash", "run", "start", "end", "total", "first_doc_id", F.col("l.doc_id").alias("l_doc"), F.col("l.text_hash").alias("l_hash"), F.col("l.start").alias("l_at"),
                       F.col("r.doc_id").alias("r_doc"), F.col("r.text_hash").alias("r_hash"), (F.col("r.start") + F.col("r.words")).alias("r_at"))
    wide = _widened(texts, runs)
    wide = materialize(wide.withColumn("n", F.col("end") + F.col("after") - F.col("start") + F.col("before")).where(F.col("n") >= min_words), "wide")

    moved = _merged(wide.select("doc_id", "text_hash", (F.col("start") - F.col("before")).alias("start"), (F.col("end") + F.col("after")).alias("end"), "first_doc_id"), 0)
    later_rows = materialize(_passages(moved, F.min("first_doc_id"), F.lit(1)), "removed")
    # where the first occurrences stand: the paragraphs of the passages kept, and what their edges were moved by
    inner = marked.join(wide.select("doc_id", "text_hash", "run"), ["doc_id", "text_hash", "run"], "left_semi").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), F.col("first.start").alias("start"), (F.col("first.start") + F.col("first.words")).alias("end")
    )
    edges = wide.select(F.col("l_doc").alias("doc_id"), F.col("l_hash").alias("text_hash"), (F.col("l_at") - F.col("before")).alias("start"), F.col("l_at").alias("end")).unionByName(
        wide.select(F.col("r_doc").alias("doc_id"), F.col("r_hash").alias("text_hash"), F.col("r_at").alias("start"), (F.col("r_at") + F.col("after")).alias("end"))
    )
    first_rows = _passages(_merged(inner.unionByName(edges).distinct(), GAP), F.first("doc_id"), F.lit(0)).where(F.col("n_words") >= min_words)
    inside = later_rows.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start_word").alias("lo"), (F.col("start_word") + F.col("n_words")).alias("hi"))
    held_by = (F.col("doc_id") == F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("start_word") >= F.col("lo")) & (F.col("start_word") + F.col("n_words") <= F.col("hi"))
    first_rows = first_rows.join(inside, held_by, "left_anti")  # a first line may hold a later passage
    out = materialize(later_rows.unionByName(first_rows), "passages")
    release(texts, units, shared, pieces, contents, held, marked, wide, later_rows)
    return out


def _passages(runs: DataFrame, first: Column, removed: Column) -> DataFrame:
    n = (F.max("end") - F.min("start")).cast("bigint")
    return (
        runs.groupBy("doc_id", "text_hash", "run")
        .agg(F.min("start").cast("int").alias("start_word"), n.alias("n_words"), first.alias("first_doc_id"), (n * F.max(removed)).alias("n_removed"))
        .select("doc_id", "start_word", "n_words", "first_doc_id", "n_removed", "text_hash")
    )


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later passages cut out of their texts; words are joined by single spaces there.

    Rows without a later passage, null texts and ids among them, are left as
    they are; rows that share an id are told apart by their text, and repeated
    rows are cut alike. Every column of ``docs`` is kept, whatever its name; an
    empty table gives no rows.
    """
    spans = passages.where("n_removed > 0").groupBy(F.col("doc_id").alias("p_doc"), F.col("text_hash").alias("p_hash"))
    spans = spans.agg(F.collect_list(F.struct("start_word", "n_words")).alias("p_spans"))
    rows = wrapped(docs)
    text = F.col("row").getField(text_col)
    words = F.filter(word_array(text), lambda w, i: ~F.exists("p_spans", lambda s: (i >= s["start_word"]) & (i < s["start_word"] + s["n_words"])))
    cut_text = F.when(F.col("p_spans").isNotNull(), F.array_join(words, " ")).otherwise(text)
    joined = rows.join(spans, (F.col("row").getField(id_col).cast("bigint") == F.col("p_doc")) & (F.xxhash64(text) == F.col("p_hash")), "left")
    return unwrapped(joined.withColumn("row", F.col("row").withField(text_col, cut_text)), docs)
