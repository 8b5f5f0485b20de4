"""Word and shingle hashes of 64 bits, and bands of MinHash values."""

from __future__ import annotations

from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(similarity: float, recall: float, rows: int = 1) -> int:
    """The fewest bands of ``rows`` values that find pairs of the similarity with at least this chance."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


class Words(dict):
    """word -> its XXH64; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word, 7)
        return x

    def of(self, words: list[bytes]) -> np.ndarray:
        return mix(np.fromiter(map(self.__getitem__, words), np.uint64, len(words)))


#: Bytes of words, not ASCII white space.
INSIDE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, as ``Words`` has them, the bytes where the words begin, where the texts begin and end, and all bytes.

    Words are cut out of the texts' bytes at once, and only distinct ones become Python objects.
    """
    held = texts.cast(pa.large_binary())
    edge = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]]
    edge = edge - edge[0]
    inside = INSIDE[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    begin = edge[:-1][edge[:-1] < len(data)]
    fresh[begin] = inside[begin]
    bounds = np.append(np.flatnonzero(fresh[inside]), np.count_nonzero(inside))
    words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[inside])]).dictionary_encode()
    n, (_, ends, raw) = len(words.dictionary), words.dictionary.buffers()
    raw, ends = bytes(raw or b""), np.frombuffer(ends, np.int64)[: n + 1].tolist()
    each = mix(np.fromiter(map(xxhash.xxh64_intdigest, [raw[a:b] for a, b in pairwise(ends)], repeat(7)), np.uint64, n))
    return each[words.indices.to_numpy()], np.flatnonzero(fresh), edge, data


def mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(29)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(32)
    y *= MIX
    return y


def shingled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * np.uint64(3) + h[k : n + k])
    return out
