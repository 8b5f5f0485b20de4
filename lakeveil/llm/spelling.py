"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

A word of L code points has L - 1 bigrams, each with its place. One edit spoils
two of them at most, and moves those after it by one place if it adds or takes a
code point. It also leaves one half of the longer word as it is.

1. A word is listed under each of its halves, with its length. It asks there
   for words as long as itself, and under the halves that a word one longer would have.
2. A section (side, half, length) is a small inverted index: lists of words by
   bigram and place, of the bigrams that the half does not hold anyway. The lists
   of a word's bigrams, at its own place or the next, are merged by a heap;
   words that come up as often as one edit must leave are verified.
3. A section with many words or questions is cut in a grid of both, a task's
   share is bounded, and every word still meets every question.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sliced

RUNS = "[a-zÀ-ÿ]"
#: A cell of a section's grid has about so many words and questions at most.
CELL_WORDS, CELL_QUESTIONS = 1_000, 4_000
HELD_WORDS = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least: int = 5, typo: int = 199) -> DataFrame:
    """word, n: the words of all texts that have the least length and number.

    Words are the longest runs of a-z and U+00C0 to U+00FF after A-Z is
    lower-cased. Where ``typo`` divides the crc32 of ``<id>:<run>``, the run loses
    its code point at that crc32 modulo its length; 0 leaves all runs as they
    are. A null id is empty, a null text has no words.
    """
    runs = re.compile(f"{RUNS}{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in sliced(batches, 200):
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(runs.findall(text.encode("utf-8", "replace").lower().decode())).items():
                    if typo and (h := zlib.crc32(run.encode(), start)) % typo == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) > HELD_WORDS:
                    yield out()
                    held = {}
        if held:
            yield out()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, as long as ``a`` or one longer, is one replaced or added code point away."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return a[i + (len(a) == len(b)) :] == b[i + 1 :]
    return len(a) < len(b)


def merged(lists: list[list[int]], least: int) -> Iterable[int]:
    """What is in ``least`` of the sorted lists or more (an entry listed twice counts twice).

    A heap holds the head of each list. Where too few lists have the head, the
    next ``least - 1`` heads are taken off too: what is before the one that
    then is first can't come up often enough, so the lists skip to it.
    """
    if least < 2:
        return set().union(*lists)
    heap = [(x[0], j, 0) for j, x in enumerate(lists)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= least:
        head, taken = heap[0][0], []
        while heap and heap[0][0] == head:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            out.append(head)
            skip = head + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            skip = heap[0][0]
        for _, j, at in taken:
            if (at := bisect.bisect_left(lists[j], skip, at)) < len(lists[j]):
                heapq.heappush(heap, (lists[j][at], j, at))
    return out


KEY = ["side", "half", "length"]


def _sections(words: DataFrame) -> DataFrame:
    """side, half, length, asks, word, n: each word under its halves, and its questions for longer words."""

    def under(extra: int) -> list[Column]:
        length = F.length("word") + extra
        cut = F.floor(length / 2).cast("int")
        halves = {"left": F.substring("word", F.lit(1), cut), "right": F.expr(f"right(word, length(word) + {extra} - cast((length(word) + {extra}) div 2 as int))")}
        return [F.struct(F.lit(side).alias("side"), half.alias("half"), length.alias("length"), F.lit(extra > 0).alias("asks")) for side, half in halves.items()]

    return words.select(F.explode(F.array(*under(0), *under(1))).alias("x"), "word", "n").select("x.*", "word", "n")


def _cells(listed: DataFrame) -> DataFrame:
    """Sections as cells (adds ``col``, ``row``); those with many words or questions are cut in a grid.

    Words are dealt over columns and questions over rows; each is copied along
    the other way. In a cut section a word's question for its own length is a row too.
    """
    sizes = listed.groupBy(*KEY).agg(F.count_if(~F.col("asks")).alias("words"), F.count_if("asks").alias("asked"))
    large = sizes.where((F.col("words") > CELL_WORDS) | ((F.col("asked") > CELL_QUESTIONS) & (F.col("words") > 0)))
    large = large.select(*KEY, F.ceil(F.col("words") / CELL_WORDS).cast("int").alias("cols"), F.ceil((F.col("words") + F.col("asked")) / CELL_QUESTIONS).cast("int").alias("rows"))
    wide = listed.join(large, KEY, "left")
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    small = wide.where("cols is null").select(*listed.columns, F.lit(0).alias("col"), F.lit(0).alias("row"), F.lit(False).alias("cut"))
    cut = wide.where("cols is not null")
    own = cut.where("not asks").withColumn("col", deal("cols")).withColumn("row", F.explode(F.expr("sequence(0, rows - 1)")))
    asks = cut.withColumn("asks", F.lit(True)).withColumn("row", deal("rows")).withColumn("col", F.explode(F.expr("sequence(0, cols - 1)")))
    return small.unionByName(own.unionByName(asks).select(*listed.columns, "col", "row", F.lit(True).alias("cut")))


def pairs(side: str, length: int, own: list[tuple[str, int]], asked: list[tuple[str, int]], cut: bool) -> Iterator[tuple[str, int, str, int]]:
    """Of one cell."""
    half, lists = length // 2, {}
    places = range(half - 1, length - 1) if side == "left" else range(half)  # of bigrams that are not inside the half
    for i, (w, _) in enumerate(own):
        for at in places:
            lists.setdefault((w[at : at + 2], at), []).append(i)
    for k, (w, n) in enumerate(asked if cut else itertools.chain(own, asked)):
        longer = len(w) < length
        if longer:
            near = [((w[at : at + 2], p)) for at in range(max(0, places[0] - 1), min(places[-1] + 1, length - 2)) for p in (at, at + 1)]
        else:
            near = [(w[at : at + 2], at) for at in places]
        for i in merged([x for g in near if (x := lists.get(g))], len(places) - 2):
            other, m = own[i]
            if longer:
                wanted = side == "left" or w[:half] != other[:half]  # else it was found on the left
            else:
                wanted = other < w if cut else i < k  # one of the two asks
            if wanted and one_edit(w, other):
                yield w, n, other, m


def near_words(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of different words (word, n) that are one inserted, deleted or replaced code point apart, once."""
    cell_key = [*KEY, "col", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by cell, which holds a bounded number of words; keeps one at a time."""
        found: list[tuple[str, int, str, int]] = []
        now, own, asked, cut = None, [], [], False
        columns = [*cell_key, "asks", "word", "n", "cut"]

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["a", "a_n", "b", "b_n"])

        end = [("", "", 0, 0, 0, False, "", 0, False)]
        for b in itertools.chain(sliced(batches, 20_000), [None]):
            for *cell, asks, word, n, is_cut in end if b is None else zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if cell != now:
                    if own and len(own) + len(asked) > 1:
                        found += pairs(now[0], now[2], own, asked, cut)
                    now, own, asked, cut = cell, [], [], is_cut
                (asked if asks else own).append((word, n))
            if len(found) > 10_000 or (b is None and found):
                yield out()
                found = []

    return _cells(materialize(_sections(words), "sections")).repartition(*cell_key).sortWithinPartitions(*cell_key).mapInArrow(run, "a string, a_n bigint, b string, b_n bigint")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least: int = 5, ratio: int = 5, typo: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n; a row for each word of ``word_counts``.

    Words are near if one inserted, deleted or replaced code point makes one the
    other. A word's form is its near word with the largest number (of equals
    the first in code-point order), if that is at least ``ratio`` times the
    word's; else null. ``root`` is the last of a chain of forms, the word itself
    without one. Null texts and null ids are as in ``word_counts``; repeated
    rows count each; an empty table gives no rows; other columns are ignored.
    ``least_length`` is 6 or more, so that a bigram must be left beside an unchanged half.
    """
    if least_length < 6 or ratio < 2:
        raise ValueError("halves of words of fewer than 6 code points are too short; a ratio under 2 allows circles")
    words = materialize(word_counts(docs, id_col, text_col, least_length, least, typo), "words")
    pairs = materialize(near_words(words), "pairs")
    ways = [pairs.select(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n")) for a, b in ("ab", "ba")]
    both = ways[0].unionByName(ways[1])
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    joined = materialize(joined, "forms")
    roots = materialize(joined.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps that are followed
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        ended = new.where("moved").isEmpty()
        release(roots)
        roots = new
        if ended:
            break
    return joined.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
