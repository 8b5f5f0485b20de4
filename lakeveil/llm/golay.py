"""The binary Golay code (23, 12): perfect, each word is within 3 bits of exactly one codeword.

A word has as keys all codewords within 4 bits: its own, and, when that is 3
bits away, five more. Two words that differ in up to 2 bits have a word between
them that is within 1 of either, so its codeword is a key of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator; 0 for codewords."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _leaders(made: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """By syndrome: the error of up to 3 bits, and the five errors of 4 bits (or zeros)."""
    if made:
        return made["near"], made["far"]
    bits = syndrome(1 << np.arange(23, dtype=np.int64))
    near, far = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64)
    for n in range(1, 4):
        for places in combinations(range(23), n):
            near[np.bitwise_xor.reduce(bits[list(places)])] = sum(1 << p for p in places)
    count = np.zeros(2048, np.int64)
    for places in combinations(range(23), 4):
        s = np.bitwise_xor.reduce(bits[list(places)])
        far[s, count[s]] = sum(1 << p for p in places)
        count[s] += 1
    made.update(near=near, far=far)
    return near, far


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own, all): 12-bit index of the nearest codeword, and the n x 6 indices within 4 bits; repeats of the own fill gaps."""
    near, far = _leaders()
    s = syndrome(words)
    own = (words ^ near[s]) >> 11
    more = np.where(far[s] > 0, (words[:, None] ^ far[s]) >> 11, own[:, None])
    return own, np.concatenate([own[:, None], more], axis=1)
