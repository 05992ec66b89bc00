"""Hashed character n-grams of a text, as numpy arrays."""

from __future__ import annotations

import numpy as np

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
PIECE = 1 << 22  # bytes that are hashed at a time


def letters(text: str) -> bytes:
    """Lower-cased words of letters with one space around each (UTF-8)."""
    words = text.lower().encode().translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _hashed(bytes_: np.ndarray, n: int, bits: int) -> np.ndarray:
    m = len(bytes_) - n + 1
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= bytes_[k:k + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def codes(words: bytes, lengths: tuple[int, ...], bits: int):
    """The bucket of every byte n-gram, in pieces of bounded size."""
    for start in range(0, len(words), PIECE):
        piece = np.frombuffer(words, np.uint8, min(PIECE + max(lengths) - 1, len(words) - start), start)
        for n in lengths:
            usable = piece[:PIECE + n - 1]
            if len(usable) >= n:
                yield _hashed(usable, n, bits)


def counts(words: bytes, lengths: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, times) of a text."""
    total = np.zeros(1 << bits, np.int64)
    for c in codes(words, lengths, bits):
        total += np.bincount(c, minlength=1 << bits)
    found = np.flatnonzero(total)
    return found, total[found]


class Present:
    """The set of buckets of a text; ``slots`` is reused from text to text."""

    def __init__(self, lengths: tuple[int, ...], bits: int):
        self.lengths, self.bits = lengths, bits
        self.slots = np.zeros(1 << bits, np.int32)

    def __call__(self, words: bytes) -> np.ndarray:
        found = np.empty(0, np.int32)
        for c in codes(words, self.lengths, self.bits):
            found = self._distinct(np.concatenate([found, c]))
        return found

    def _distinct(self, c: np.ndarray) -> np.ndarray:
        place = np.arange(len(c), dtype=np.int32)
        self.slots[c] = place  # the last place of a bucket stays
        return c[self.slots[c] == place]
