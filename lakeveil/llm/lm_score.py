"""Language-model scores: a pretrained byte model by partial matching, and a word base.

Nothing that grows with the corpus is ever sent whole. Documents are grouped in
chunks, each with a dictionary of its words and one of its byte grams, packed in
parts. A part of the words adds up the counts of all chunks and answers each
with the corpus counts of its words. A gram's code length depends on the gram
alone; all contexts of three bytes or more that it can ask for end in the same
three bytes, so the trie is cut in parts by these, and what follows a frequent pair
of bytes is spread over many parts. A part merges the grams of all chunks,
``SLICE`` chunks a task and then ``SLICE`` results a task, counts its own levels, is
given those of the three lowest that its contexts end in (of grams of three
bytes, a number that the alphabet bounds), and answers the chunks, ``SLICE`` a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ppm
from .common import materialize, sliced

#: A chunk ends when it has more bytes of text, distinct words or rows than these.
CHUNK_BYTES, CHUNK_WORDS, CHUNK_ROWS, PARTS = 16_000_000, 300_000, 100_000, 1024
#: Chunks whose dictionaries of one part meet in a task.
SLICE = 64


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def pack(x: np.ndarray) -> bytes:
    """64-bit values, byte by byte of their weight."""
    return zlib.compress(x.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def by_part(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From sorted grams: their order by part (sorted inside it), and where each part starts and the last ends."""
    part = (((code >> np.uint64(8)) & np.uint64(0xFFFFFF)) * ppm.MULT >> np.uint64(54)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=PARTS))])


def unpacked(rows: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for codes, counts in rows:
        yield np.cumsum(unpack(codes), dtype=np.uint64), unpack(counts).view(np.int64)


def merged(rows: Iterable[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of some dictionaries, with their counts in all of them."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for part in unpacked(rows):
        parts.append(part)
        if sum(len(k) for k, _ in parts) > max(1_000_000, 2 * len(parts[0][0])):
            parts[:] = [ppm.merge(parts)]
    return ppm.merge(parts)


def _trained(grams: DataFrame, slices: int) -> DataFrame:
    """part, codes, counts: the training grams of each part, merged in a tree whose tasks take ``SLICE`` dictionaries."""

    def solve(key, rows):
        code, n = merged(zip(rows.column("codes").to_pylist(), rows.column("counts").to_pylist(), strict=True))
        code, n = code[n > 0], n[n > 0]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int64()), "codes": [pack(np.diff(code, prepend=np.uint64(0)))], "counts": [pack(n)]})

    now = grams
    while True:
        now = materialize(now.groupBy("part", "slice").applyInArrow(solve, "part int, slice bigint, codes binary, counts binary"), "merged")
        if slices <= 1:
            return now.select("part", "codes", "counts")
        slices = -(-slices // SLICE)
        now = now.withColumn("slice", F.pmod(F.xxhash64("slice"), F.lit(slices)))


def code_lengths(grams: DataFrame, tail: DataFrame, order: int = ppm.ORDER) -> DataFrame:
    """of, part, lengths (log10, float32) for each row of ``grams`` (chunk, part, codes, counts: 0 where the training texts lack one).

    ``tail``: gram, n, the last three bytes of all grams, repeated.
    """
    low = tail.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the alphabet
    key, count = ppm.count_levels(low.column("gram").to_numpy().view(np.uint64), low.column("n").to_numpy(), min(2, order))
    rank = np.argsort(key)
    key, count = key[rank], count[rank]
    whole = int(np.searchsorted(key, np.uint64(2 << 56)))

    def answers(part: int, chunks: list[int], rows: list[tuple[bytes, bytes]], code: np.ndarray, n: np.ndarray) -> pa.Table:
        """The lengths of each dictionary's grams; code, n: the part's grams, and all that are asked for with a count of 0."""
        pairs = np.unique((code >> np.uint64(8)) & np.uint64(0xFFFF)) << np.uint64(8) | np.uint64(2 << 56)
        lo, hi = np.searchsorted(key, pairs), np.searchsorted(key, pairs + np.uint64(256))
        use = np.concatenate([np.arange(whole), *[np.arange(a, b) for a, b in zip(lo, hi, strict=True)]])
        own, m = ppm.count_levels(code[n > 0], n[n > 0], order)
        high = own >= np.uint64(3 << 56)
        lengths = ppm.Model.whole(np.concatenate([own[high], key[use]]), np.concatenate([m[high], count[use]]), order).code_lengths(code).astype(np.float32)
        out = [lengths[np.searchsorted(code, own)].tobytes() for own, _ in unpacked(rows)]
        return pa.table([pa.array(chunks, pa.int64()), pa.array([part] * len(chunks), pa.int32()), pa.array(out, pa.binary())], names=["of", "part", "lengths"])

    schema = "of bigint, part int, lengths binary"
    slices = -(-grams.select("chunk").distinct().count() // SLICE)
    if slices <= 1:  # all dictionaries of a part meet in one task anyway

        def solve(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            held = [(codes, counts) for _, codes, counts in rows]
            return answers(part, [c for c, _, _ in rows], held, *merged(held)).combine_chunks().to_batches()[0]

        return _by_parts(grams, "codes", solve, schema)
    sliced_grams = grams.withColumn("slice", F.pmod(F.xxhash64("chunk"), F.lit(slices)))
    every = _trained(sliced_grams, slices).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))))

    def some(at, left, right):
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["of", "part", "lengths"])
        rows = list(zip(left.column("codes").to_pylist(), left.column("counts").to_pylist(), strict=True))
        asked = [(k, np.zeros_like(n)) for k, n in unpacked(rows)]
        trained = list(unpacked(zip(right.column("codes").to_pylist(), right.column("counts").to_pylist(), strict=True)))
        return answers(at[0].as_py(), left.column("chunk").to_pylist(), rows, *ppm.merge([*asked, *trained]))

    return sliced_grams.groupBy("part", "slice").cogroup(every.groupBy("part", "slice")).applyInArrow(some, schema)


def word_counts(words: DataFrame) -> DataFrame:
    """of, words, counts (in the whole corpus), tokens, distinct (training words and those with a count, once a part) for each row of ``words`` (chunk, part, words, counts)."""

    def solve(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        total: dict[bytes, int] = {}
        for _, words, counts in rows:
            for w, n in zip(zlib.decompress(words).split(b" "), unpack(counts).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        out = [pack(np.fromiter(map(total.__getitem__, zlib.decompress(words).split(b" ")), np.int64)) for _, words, _ in rows]
        tokens, distinct = np.zeros((2, len(rows)), np.int64)
        tokens[0], distinct[0] = sum(total.values()), sum(n > 0 for n in total.values())
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in rows], pa.int64()), pa.array([w for _, w, _ in rows], pa.binary()), pa.array(out, pa.binary()), pa.array(tokens), pa.array(distinct)], ["of", "words", "counts", "tokens", "distinct"])

    return _by_parts(words, "words", solve, "of bigint, words binary, counts binary, tokens bigint, distinct bigint")


def _by_parts(rows: DataFrame, packed: str, solve: Callable[[int, list], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by part; holds the packed dictionaries of one."""
        now, held = -1, []
        for b in batches:
            for part, *row in zip(*(b.column(c).to_pylist() for c in ("part", "chunk", packed, "counts")), strict=True):
                if part != now and held:
                    yield solve(now, held)
                    held = []
                now = part
                held.append(row)
        if held:
            yield solve(now, held)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ppm.ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row.

    A null text counts as empty: one token, the end. Rows whose crc32 of the id
    as text is 1 modulo 5 are held out of all counts; a null id is not held out.
    Words are runs of anything but ASCII white space with A-Z lower-cased.
    Repeated rows are counted and scored each for itself. With no training rows
    the byte model knows nothing and all bytes are equally likely. An empty
    table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held", held_out(F.col("doc_id")))
    names = ["chunk", "gram", "n", "part", "words", "codes", "counts", "doc_id", "held", "text"]
    schema = f"chunk bigint, gram bigint, n bigint, part int, words binary, codes binary, counts binary, doc_id {kind}, held boolean, text binary"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as they come, and after those of a chunk its words and grams with their counts in training rows."""
        part, seq = TaskContext.get().partitionId(), 0
        words: dict[bytes, int] = {}
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        size, n_rows, docs_type = 0, 0, None

        def batch(k: int, **given) -> pa.RecordBatch:
            kinds = dict(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), docs_type, pa.bool_(), pa.binary()), strict=True))
            given["chunk"] = [(part << 24) + seq] * k
            return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(k, t) for c, t in kinds.items()], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal words, size, n_rows, seq
            found: dict[int, list[bytes]] = {}
            for w in words:
                found.setdefault(zlib.crc32(w) % PARTS, []).append(w)
            of = found.values()
            yield batch(len(of), part=list(found), words=[zlib.compress(b" ".join(ws), 1) for ws in of], counts=[pack(np.fromiter(map(words.__getitem__, ws), np.int64)) for ws in of])
            key, n = ppm.merge(grams)
            tail, m = ppm.merge([(key & np.uint64(0xFFFFFF), n)])
            yield batch(len(tail), gram=tail.view(np.int64), n=m)
            rank, edge = by_part(key)
            key, n = key[rank], n[rank]
            full = np.flatnonzero(np.diff(edge))
            spans = [slice(edge[p], edge[p + 1]) for p in full]
            yield batch(len(full), part=full.astype(np.int32), codes=[pack(np.diff(key[s], prepend=np.uint64(0))) for s in spans], counts=[pack(n[s]) for s in spans])
            words, size, n_rows, seq = {}, 0, 0, seq + 1
            grams.clear()

        def count(texts: list[bytes], trained: bool) -> None:
            at = 0
            while at < len(texts):
                mass, end = 0, at
                while end < len(texts) and (end == at or mass + len(texts[end]) < 2_000_000):
                    mass += len(texts[end])
                    end += 1
                code, n = np.unique(ppm.codes(texts[at:end], order)[0], return_counts=True)
                grams.append((code, n.astype(np.int64) * trained))
                at = end
            if sum(len(k) for k, _ in grams) > 2_000_000:
                grams[:] = [ppm.merge(grams)]

        for b in sliced(batches):
            docs_type = b.column("doc_id").type
            texts = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            held = b.column("held").to_pylist()
            start = 0
            for at, text in enumerate(texts):
                n = 0 if held[at] else 1
                for w in text.lower().split():
                    words[w] = words.get(w, 0) + n
                words[b""] = words.get(b"", 0) + n
                size, n_rows = size + len(text), n_rows + 1
                full = size > CHUNK_BYTES or len(words) > CHUNK_WORDS or n_rows >= CHUNK_ROWS
                if full or at + 1 == len(texts):
                    some = slice(start, at + 1)
                    for trained in (True, False):
                        count([t for t, h in zip(texts[some], held[some], strict=True) if h != trained], trained)
                    yield batch(at + 1 - start, doc_id=b.column("doc_id")[some], held=held[some], text=texts[some])
                    start = at + 1
                    if full:
                        yield from flush()
        if words:
            yield from flush()

    both = materialize(rows.mapInArrow(chunks, schema), "chunks")
    counted = materialize(word_counts(both.where("words is not null").select("chunk", "part", "words", "counts")), "vocabulary")
    train_tokens, distinct = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("distinct")).first())
    lengths = code_lengths(both.where("codes is not null").select("chunk", "part", "codes", "counts"), both.where("gram is not null").select("gram", "n"), order)
    answers = counted.select("of", "words", "counts").unionByName(lengths, allowMissingColumns=True)
    members = both.where("text is not null").select("chunk", "doc_id", "held", "text")
    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def base(key, left, right):
        """One chunk: its documents, the corpus counts of its words and the code lengths of its grams."""
        of_words, of_parts = (right.filter(right.column(c).is_valid()) for c in ("words", "part"))
        counts: dict[bytes, int] = {}
        for words, n in zip(of_words.column("words").to_pylist(), of_words.column("counts").to_pylist(), strict=True):
            counts.update(zip(zlib.decompress(words).split(b" "), unpack(n).tolist(), strict=True))
        lengths = np.frombuffer(b"".join(of_parts.sort_by("part").column("lengths").to_pylist()), np.float32)
        n_tokens, n_known, score = [], [], []
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of some texts: distinct grams, which of them each byte has, each text's size
        for some in sliced(left.select(["text"]).to_batches(), 200):
            texts = some.column("text").to_pylist()
            for text in texts:
                c = np.fromiter(map(counts.__getitem__, [*text.lower().split(), b""]), np.int64)
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                score.append(float(np.log10((c + 0.5) / (train_tokens + 0.5 * (distinct + 1))).sum()))
            code, sizes = ppm.codes(texts, order)
            code, at = np.unique(code, return_inverse=True)
            seen.append((code, at.astype(np.int32), sizes))
        code = np.unique(np.concatenate([c for c, _, _ in seen]))
        found = np.empty(len(code), np.float32)
        found[by_part(code)[0]] = lengths
        bits = [np.add.reduceat(found[np.searchsorted(code, c)][at].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]])) for c, at, sizes in seen]
        k = left.num_rows
        return pa.table(
            [left.column("doc_id"), left.column("held"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([train_tokens] * k, pa.int64()), pa.array(score, pa.float64()), pa.array(np.concatenate(bits))],
            names=out_names,
        )

    return members.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(
        base, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
