"""Prediction by partial matching over bytes: a context trie as sorted arrays, and its code lengths.

The probability of a byte comes from the longest context of up to ``ORDER``
bytes that the trie knows. If the byte is not among that context's children,
an escape is paid and the next shorter context is asked, with the children of
the longer one excluded. Escape mass is method D (half a count for each child) plus
the mass of children too rare to be in the trie. Below order 0 the bytes left
are equally likely. Byte 0xFF, which UTF-8 never has, stands before and after
each text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ORDER = 5
EDGE = 0xFF
MULT = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(order + 1)-byte grams ending at each byte of each text and at its end; and each text's number of grams."""
    pad = bytes([EDGE]) * order
    buffer = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    out = np.zeros(len(buffer) - order, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | buffer[k : len(buffer) - order + k]
    real = np.ones(len(out), bool)
    starts = np.cumsum(sizes + order)[:-1]
    for k in range(order):  # grams that end in the next text's pad
        real[starts - order + k] = False
    return out[real], sizes


def tag(code: np.ndarray, level: int) -> np.ndarray:
    return (code & np.uint64((1 << (8 * (level + 1))) - 1)) | np.uint64(level << 56)


def count_levels(code: np.ndarray, n: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Tagged grams of all levels with their counts, from distinct top grams."""
    keys, counts = [tag(code, order)], [n]
    for level in range(order - 1, -1, -1):
        code, at = np.unique(code & np.uint64((1 << (8 * (level + 1))) - 1), return_inverse=True)
        n = np.bincount(at, n, len(code)).astype(np.int64)
        keys.append(tag(code, level))
        counts.append(n)
    return np.concatenate(keys), np.concatenate(counts)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


class Table:
    """Open-addressed map from keys to columns of float32; lookups are vectorised."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.columns = [np.zeros(1 << bits, np.float32) for _ in columns]
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            for mine, given in zip(self.columns, columns, strict=True):
                mine[at[done]] = given[left[done]]
            at, left = (at[~done] + 1) & self.mask, left[~done]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 where a key is missing."""
        at = self._slot(keys)
        seen = self.keys[at]
        miss = np.flatnonzero(seen != keys)
        while len(miss):
            gone = self.keys[at[miss]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            at[miss[gone]] = -1
            miss = miss[~gone]
            at[miss] = (at[miss] + 1) & self.mask
            miss = miss[self.keys[at[miss]] != keys[miss]]
        return at


class Model:
    """``key``, ``n``: tagged grams in the trie; ``context``, ``total``: tagged contexts (level, gram >> 8) and all their mass."""

    def __init__(self, key: np.ndarray, n: np.ndarray, context: np.ndarray, total: np.ndarray, order: int = ORDER):
        self.order = order
        rank = np.argsort(key)
        key, n = key[rank], n[rank].astype(np.float64)
        low = np.uint64((1 << 56) - 1)
        level = (key >> np.uint64(56)).astype(np.int64)
        own = ((key & low) >> np.uint64(8)) | (key & ~low)
        rank = np.argsort(context)
        context, total = context[rank], total[rank].astype(np.float64)
        at = np.searchsorted(context, own)
        kept, children = np.bincount(at, n, len(context)), np.bincount(at, minlength=len(context)).astype(np.float64)
        # the same byte after the context without its first byte
        shorter = np.where(level > 0, tag_each(key & low, level - 1), key)
        below = np.where(level > 0, n[np.clip(np.searchsorted(key, shorter), 0, len(key) - 1)], 0.0)
        excluded = np.bincount(at, below, len(context))
        clevel = (context >> np.uint64(56)).astype(np.int64)
        up = np.where(clevel > 0, context_each(context & low, clevel - 1), context)
        parent = np.clip(np.searchsorted(context, up), 0, max(0, len(context) - 1))
        z, e = total, children / 2 + (total - kept)
        ex = np.where(clevel > 0, (children[parent] - children) / 2 + total[parent] - kept[parent], 1.0)
        zx = np.where(clevel > 0, total[parent] - excluded, 1.0)
        none = zx <= 0
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        # where all is excluded the escape is certain; an escape without mass can't be taken
        zx, ex = np.where(none, 0.0, log(zx)), np.where(none, 0.0, np.where(ex > 0, log(ex), log(np.maximum(zx, 1e-300)) - 12))
        self.contexts = Table(context, log(z), np.where(e > 0, log(e), -12.0), zx, ex)
        self.grams = Table(key, np.where(level == order, log(n - 0.5) - log(z)[at], log(n - 0.5)))
        roots = children[clevel == 0].sum()
        self.floor = -float(np.log10(max(1.0, 256 - roots)))

    @classmethod
    def whole(cls, key: np.ndarray, n: np.ndarray, order: int = ORDER) -> Model:
        """From tagged grams of which none is left out."""
        low = np.uint64((1 << 56) - 1)
        context, at = np.unique(((key & low) >> np.uint64(8)) | (key & ~low), return_inverse=True)
        return cls(key, n, context, np.bincount(at, n, len(context)), order)

    def arrays(self) -> dict:
        """All there is as plain values, to be sent without a second copy."""
        return {"order": self.order, "floor": self.floor, "contexts": vars(self.contexts), "grams": vars(self.grams)}

    @classmethod
    def of(cls, arrays: dict) -> Model:
        out = object.__new__(cls)
        out.order, out.floor = arrays["order"], arrays["floor"]
        for name in ("contexts", "grams"):
            part = object.__new__(Table)
            vars(part).update(arrays[name])
            setattr(out, name, part)
        return out

    def code_lengths(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after its context."""
        slot = self.grams.find(tag(code, self.order))
        out = np.where(slot >= 0, self.grams.columns[0][slot], 0).astype(np.float64)
        left = np.flatnonzero(slot < 0)
        code = code[left]
        spent = np.zeros(len(left))
        z = e = np.zeros(len(left))
        escaped = np.zeros(len(left), bool)
        for level in range(self.order, -1, -1):
            if not len(left):
                break
            gram = tag(code, level)
            at = self.contexts.find(((gram & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | np.uint64(level << 56))
            known = at >= 0
            c = self.contexts.columns
            z = np.where(escaped, z, c[0][at])
            e = np.where(escaped, e, c[1][at])
            hit = self.grams.find(gram) if level < self.order else np.full(len(left), -1)
            found = known & (hit >= 0)
            out[left[found]] = spent[found] + self.grams.columns[0][hit[found]] - z[found]
            spent = np.where(known & ~found, spent + e - z, spent)
            z, e = np.where(known, c[2][at], z), np.where(known, c[3][at], e)
            escaped |= known
            go = ~found
            left, code, spent, z, e, escaped = left[go], code[go], spent[go], z[go], e[go], escaped[go]
        out[left] = spent + self.floor
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        return sums(texts, self.code_lengths, self.order)


def sums(texts: list[bytes], lengths: Callable[[np.ndarray], np.ndarray], order: int = ORDER) -> np.ndarray:
    """The sum of ``lengths(codes)`` over each text and its end."""
    if not texts:
        return np.empty(0)
    out = []
    at = 0
    while at < len(texts):  # blocks of a MB
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
            size += len(texts[end])
            end += 1
        code, sizes = codes(texts[at:end], order)
        out.append(np.add.reduceat(lengths(code).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]])))
        at = end
    return np.concatenate(out)


def tag_each(code: np.ndarray, level: np.ndarray) -> np.ndarray:
    width = (8 * (np.maximum(level, 0) + 1)).astype(np.uint64)
    return (code & ((np.uint64(1) << width) - np.uint64(1))) | (np.maximum(level, 0).astype(np.uint64) << np.uint64(56))


def context_each(code: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Contexts of ``level`` bytes."""
    width = (8 * np.maximum(level, 0)).astype(np.uint64)
    return (code & ((np.uint64(1) << width) - np.uint64(1))) | (np.maximum(level, 0).astype(np.uint64) << np.uint64(56))
