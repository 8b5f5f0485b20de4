"""Names by a sequence model: a hidden Markov model over tokens, counted by Spark, decoded by Viterbi in Arrow batches.

A token shows five things: itself, its shape, its last three letters, and the
words before and after it. Their numbers by tag are counted over all labelled
texts with one aggregation; each kind of evidence has ``BUCKETS`` buckets, so the
model has a bounded size whatever the texts are. Scores are whole thousandths of
natural logarithms, so decoding is exact. The tags begin or go on with a name of
some label, or are outside; a name can only go on after its own label.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ["PERSON", "ORG", "GPE"]
TAGS = ["O", *[f"{p}-{x}" for x in LABELS for p in "BI"]]
BUCKETS, KINDS, NEVER = 65_536, 5, -1_000_000
LETTERS = "A-Za-z0-9_À-ɏ"
TOKEN = re.compile(f"[{LETTERS}]+|[^{LETTERS}\\s]")
WORD = re.compile(f"[{LETTERS}]")


class Model(NamedTuple):
    """emission[kind, bucket, tag], and transition[from, to], where the last row is the beginning of a sentence."""

    emission: np.ndarray
    transition: np.ndarray


@lru_cache(200_000)
def bucket(evidence: str) -> int:
    return int.from_bytes(hashlib.md5(evidence.encode("utf-8", "replace")).digest()[:2])


def shape(token: str) -> str:
    """Xx for a capital and more, X for a capital alone, d for digits, x for other words, . for marks."""
    if not WORD.match(token):
        return token
    if "A" <= token[0] <= "Z":
        return "X" if len(token) == 1 else "XX" if token.isupper() else "Xx"
    return "d" if token.isdigit() and token.isascii() else "x"


def low(token: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in token)


def evidence(tokens: list[str]) -> list[tuple[int, ...]]:
    """A bucket of each kind for each token."""
    out, words = [], [low(t) if WORD.match(t) else "" for t in tokens]
    before, after = [""] * len(tokens), [""] * len(tokens)
    for i in range(1, len(tokens)):
        before[i] = words[i - 1] or before[i - 1]
        after[-1 - i] = words[-i] or after[-i]
    for i, t in enumerate(tokens):
        out.append(tuple(map(bucket, (low(t), shape(t), low(t)[-3:], before[i], after[i]))))
    return out


def sentences(tokens: list[str]) -> list[tuple[int, int]]:
    """Runs of tokens up to a full stop, question or exclamation mark."""
    ends = [i + 1 for i, t in enumerate(tokens) if t in ".!?"]
    if tokens and (not ends or ends[-1] < len(tokens)):
        ends.append(len(tokens))
    return list(zip([0, *ends], ends, strict=False))


def tags_of(places: list[tuple[int, int]], spans: list) -> list[int]:
    """The tag of each token from labelled spans (start, end, label); a token belongs to the span that holds its beginning."""
    out = [0] * len(places)
    for s in spans or []:
        own = [i for i, (a, _) in enumerate(places) if s["start"] <= a < s["end"]]
        for k, i in enumerate(own):
            out[i] = TAGS.index(f"{'I' if k else 'B'}-{s['label']}")
    return out


def fit(labelled: DataFrame, text_col: str = "text", spans_col: str = "spans") -> Model:
    """From texts and their spans (array of start, end, label). Null texts count for nothing; no texts give a model that finds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, int, int], int] = {}
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                places = [m.span() for m in TOKEN.finditer(text)]
                tokens = [text[s:e] for s, e in places]
                tags = tags_of(places, spans)
                for own, t in zip(evidence(tokens), tags, strict=True):
                    for kind, x in enumerate(own):
                        found[kind, x, t] = found.get((kind, x, t), 0) + 1
                for s, e in sentences(tokens):
                    for a, t in zip([len(TAGS), *tags[s:e]], tags[s:e], strict=False):
                        found[-1, a, t] = found.get((-1, a, t), 0) + 1
            rows = list(found)
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.int32()) for i in range(3)], pa.array(list(found.values()), pa.int64())], ["kind", "at", "tag", "n"])

    rows = labelled.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(spans_col).alias("spans"))
    counts = rows.mapInArrow(run, "kind int, at int, tag int, n bigint").groupBy("kind", "at", "tag").agg(F.sum("n").alias("n")).toArrow()  # at most kinds x buckets x tags
    n = np.zeros((KINDS, BUCKETS, len(TAGS)), np.int64)
    steps = np.zeros((len(TAGS) + 1, len(TAGS)), np.int64)
    for kind, at, t, k in zip(*(counts.column(c).to_pylist() for c in ("kind", "at", "tag", "n")), strict=True):
        if kind < 0:
            steps[at, t] = k
        else:
            n[kind, at, t] = k
    emission = np.zeros(n.shape, np.int32)
    for kind in range(KINDS):
        for t in range(len(TAGS)):
            total = int(n[kind, :, t].sum())
            values, where = np.unique(n[kind, :, t], return_inverse=True)
            emission[kind, :, t] = np.array([score(int(v), total, BUCKETS) for v in values])[where]
    transition = np.array([[score(int(steps[a, t]), int(steps[a].sum()), len(TAGS)) if allowed(a, t) else NEVER for t in range(len(TAGS))] for a in range(len(TAGS) + 1)])
    return Model(emission, transition)


def score(n: int, total: int, ways: int) -> int:
    """Thousandths of the logarithm of n out of total, with a tenth added for each of the ways."""
    return math.floor(1000 * math.log((10 * n + 1) / (10 * total + ways)) + 0.5)


def allowed(a: int, t: int) -> bool:
    """An inner tag (even, from 2) follows its own label only."""
    return t == 0 or t % 2 == 1 or a in (t - 1, t)


def decode(model: Model, texts: list[list[tuple[int, ...]]]) -> list[list[int]]:
    """The best tags of each sequence of evidence, all sequences a step at a time; of equally good ones the lower tags, from the end."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order])
    live = int((lengths > 0).sum())
    if not live:
        return [[] for _ in texts]
    flat = np.array([x for i in order[:live] for x in texts[i]])
    first = np.concatenate([[0], np.cumsum(lengths[:live])[:-1]])
    emitted = sum(model.emission[k, flat[:, k]].astype(np.int64) for k in range(KINDS))
    now = model.transition[-1] + emitted[first]
    back = np.zeros((len(flat), len(TAGS)), np.int8)
    for step in range(1, int(lengths[0])):
        n = int((lengths > step).sum())
        ways = now[:n, :, None] + model.transition[:-1][None]
        back[first[:n] + step] = ways.argmax(axis=1)
        now[:n] = ways.max(axis=1) + emitted[first[:n] + step]
    out: list[list[int]] = [[] for _ in texts]
    for row, i in enumerate(order[:live]):
        t = int(now[row].argmax())
        tags = [t]
        for at in range(first[row] + lengths[row] - 1, first[row], -1):
            t = int(back[at, t])
            tags.append(t)
        out[i] = tags[::-1]
    return out


SPANS = "array<struct<start:int,end:int,label:string>>"


def tag_names(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, names (start, end, label, in code points); a row for each row. Null texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = b.slice(at, 100)
                runs, owner, places = [], [], []
                for i, text in enumerate(some.column("text").to_pylist()):
                    spots = [m.span() for m in TOKEN.finditer(text or "")]
                    tokens = [text[s:e] for s, e in spots]
                    seen = evidence(tokens)
                    for s, e in sentences(tokens):
                        runs.append(seen[s:e])
                        places.append(spots[s:e])
                        owner.append(i)
                names: list[list[dict]] = [[] for _ in range(some.num_rows)]
                for i, spots, tags in zip(owner, places, decode(model, runs), strict=True):
                    for (s, e), t in zip(spots, tags, strict=True):
                        if t % 2:
                            names[i].append({"start": s, "end": e, "label": TAGS[t][2:]})
                        elif t:
                            names[i][-1]["end"] = e
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), pa.array(names, pa.list_(span))], ["doc_id", "text", "names"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string, names {SPANS}")
