"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-gram indicators, hashed to ``2**BITS`` numbers:
words, pairs of words, and runs of word shapes (``NOW!!`` is ``A!``, a word equal
to the one before it has a mark), the latter also by how large a share of the
text they make up. Each indicator is scaled by its class log-count ratio, counted
over all labelled rows; rows are brought to length one, and a linear hinge-loss
model is fitted by dual coordinate descent. Margins become probabilities by a
logistic curve, fitted on labelled rows that the model has not seen.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common  # noqa: F401  functions travel by value
from .common import materialize, release, wrapped

BITS = 18
SIZE = 1 << BITS
#: Labelled rows used for the hinge-loss fit and for the curve; ratios are counted over all of them.
FIT_ROWS, CURVE_ROWS = 8000, 2000
#: Bytes of their indicators (4 each) that the driver takes at most; rows beyond, by the order of their hashes, are left out of the fit.
FIT_BYTES = 96_000_000


class Words(dict):
    """word -> its hash above its shape's hash; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        text, shape = word.decode("utf-8", "replace"), []
        for c in text[:64]:
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not shape or shape[-1] != k:
                shape.append(k)
        code = zlib.crc32(word) << 31 | zlib.crc32("".join(shape[:6]).encode("utf-8", "replace")) >> 1
        if len(self) > 400_000:
            self.clear()
        self[word] = code
        return code


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    return (((x.astype(np.uint64) + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(text: str | None, cache: Words) -> np.ndarray:
    """Sorted distinct numbers of the text's n-grams; none for a text without words."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.int64)
    code = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    word, shape = code >> 31, code & 0x7FFFFFFF
    shape[1:] ^= np.where(code[1:] == code[:-1], 0x5A5A5A, 0)
    pair = (shape[:-1] << 13) ^ shape[1:]
    out = [_slot(word, 1), _slot((word[:-1] << 29) ^ word[1:], 2)]
    for kind, run in ((3, shape), (4, pair)):
        if len(run):
            distinct, n = np.unique(run, return_counts=True)
            out.append(_slot(distinct, kind))
            share = np.minimum(5, np.floor(-np.log2(n / len(run)))).astype(np.int64)
            for level in range(5):
                out.append(_slot(distinct[share <= level], 16 * kind + level))
    return np.unique(np.concatenate(out))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum c_i max(0, 1 - y_i (w x_i + b)); the bias is a constant input.

    ``values`` are the scales of the indicators; each row has length one. Both
    classes get the same total cost.
    """
    w, bias = np.zeros(len(values)), 0.0
    length = [max(1e-9, math.sqrt(float((v := values[r]) @ v))) for r in rows]
    top = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * cost * len(y) / 2
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            x = values[rows[i]] / length[i]
            gradient = y[i] * (float(w[rows[i]] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / 2, 0.0), top[i])  # |x|^2 + 1 = 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps, with Platt's softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """``labelled``: doc_id, text, label (0 or 1). (weights times scales, scales squared, bias, a, b)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cache = np.zeros((2, SIZE + 1), np.int64), Words()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                n[y, indicators(text, cache)] += 1
                n[y, SIZE] += 1
        used = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[0, used]), pa.array(n[1, used])], ["slot", "bad", "good"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for b in batches:
            raw = [indicators(t, cache).astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("order"), pa.array(raw, pa.binary()), b.column("label")], ["order", "slots", "label"])

    # at most SIZE + 1 rows
    counts = labelled.mapInArrow(count, "slot int, bad bigint, good bigint").groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = np.zeros((2, SIZE + 1))
    for r in counts.collect():
        n[:, r["slot"]] = r["bad"], r["good"]
    good, bad = n[1, :SIZE] + 1, n[0, :SIZE] + 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    # the rows with the lowest hashes of their ids; only hashes are sorted, and texts stay where they are
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    last = labelled.select(order.alias("order")).orderBy("order").limit(FIT_ROWS + CURVE_ROWS).agg(F.max("order")).first()[0]
    chosen = labelled.where(order <= F.lit(last)).withColumn("order", order)
    described = materialize(chosen.select("order", "text", "label").mapInArrow(describe, "order bigint, slots binary, label int"), "fit")
    # as many bytes a row as leave the whole within the bound; the table has FIT_ROWS + CURVE_ROWS rows, and repeats of the last id
    sizes = sorted((r["order"], r["n"]) for r in described.groupBy("order").agg(F.sum(F.octet_length("slots")).alias("n")).collect())
    upto = np.searchsorted(np.cumsum([n for _, n in sizes]), FIT_BYTES, "right")
    sample = described.where(F.col("order") <= sizes[max(0, upto - 1)][0]).limit(FIT_ROWS + CURVE_ROWS).collect() if sizes else []
    release(described)
    sample.sort(key=lambda r: (r["order"], bytes(r["slots"])))
    rows = [np.frombuffer(r["slots"], np.int32) for r in sample]
    y = np.array([1.0 if r["label"] else -1.0 for r in sample])
    if not len(y) or len(set(y)) < 2:  # nothing to tell apart: the share of good labels, for all
        share = (n[1, SIZE] + 1) / (n.sum(axis=0)[SIZE] + 2)
        return np.zeros(SIZE), np.ones(SIZE), 0.0, 1.0, math.log(share / (1 - share))
    held = np.arange(len(y)) % 5 == 0
    fit = np.flatnonzero(~held)
    w, bias = dual_coordinate_descent([rows[i] for i in fit], ratio, y[fit])
    weight, square = w * ratio, ratio * ratio
    margin = np.array([_margin(rows[i], weight, square, bias) for i in np.flatnonzero(held)])
    a, b = fit_curve(margin, y[held]) if len(set(y[held])) == 2 else (4.0, 0.0)
    return weight, square, bias, a, b


def _margin(slots: np.ndarray, weight: np.ndarray, square: np.ndarray, bias: float) -> float:
    return float(weight[slots].sum()) / max(1e-9, math.sqrt(float(square[slots].sum()))) + bias


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, text, label of the rows to learn from: labelled 0 or 1, and not in the held-out fold."""
    learn = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds != held_fold, F.lit(False))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    marks = marks.where(learn(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    # the fold is left out before texts are shuffled; one join strategy at every size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(learn(F.col("doc_id")))
    return rows.join(marks.hint("merge"), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7, keep_columns: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; or with ``keep_columns`` row (all of ``docs``) and score.

    Only the text is an input of a score. Rows whose crc32 of the id as text is
    2 modulo 4 are held out of all learning; a null id is not held out. A text
    without words (null, empty) has no indicators and gets the score of the bias
    alone. An id with several labels counts as its lowest. Repeated rows score
    alike. Without two classes to learn from, every score is the share of good
    labels. An empty table gives no rows; further columns are ignored.
    """
    learn = materialize(labelled_rows(docs, labels, id_col, text_col, label_col), "labelled")
    weight, square, bias, a, b = train(learn)
    weight, square = weight.astype(np.float32), square.astype(np.float32)
    source = wrapped(docs).select("row", F.col("row").getField(text_col).alias("text")) if keep_columns else docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for batch in batches:
            m = np.array([_margin(indicators(t, cache), weight, square, bias) for t in batch.column("text").to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(a * m + b, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], ["row", "score"])

    from pyspark.sql.types import DoubleType, StructType

    scored = source.mapInArrow(run, StructType([source.schema["row"]]).add("score", DoubleType()))
    if keep_columns:
        return scored
    held = F.coalesce(F.crc32(F.col("row").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select(F.col("row").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
