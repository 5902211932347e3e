"""Vectorised hashing of words, shingles and character n-grams with numpy, used inside Arrow batches."""

from __future__ import annotations

import numpy as np

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

_TURN = 1 << 16  # positions in a word at which the table of powers starts over
_POWERS = np.cumprod(np.full(_TURN, 0x9E3779B97F4A7C15, np.uint64))
_SALTS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.translate(_ASCII_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the whole text, A-Z lower-cased, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.arange(len(data))
    at -= np.maximum.accumulate(np.where(first, at, 0))
    power = _POWERS[at & (_TURN - 1)]
    if len(data) > _TURN:
        power = mix(power + (at >> 16).astype(np.uint64))
    values = (_LOWER[data] + np.uint64(1)) * power
    values[~inside] = 0
    return mix(np.add.reduceat(values, starts))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; a text of fewer words, but not none, is one shingle."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    width = min(n, k)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += words[i : n - width + 1 + i] * _SALTS[i]
    return np.unique(mix(total + np.uint64(width)))


class GramHasher:
    """Distinct hashed character n-grams of a text. Holds a scratch table of one entry per bucket."""

    def __init__(self, bits: int, orders: tuple[int, ...]):
        self.bits, self.orders = bits, orders
        self._mark = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str) -> np.ndarray:
        """Bucket numbers, each once, of the n-grams of the lower-cased text; empty for an empty text."""
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        found, h = [], np.zeros(len(code), np.uint64)
        for n in range(1, max(self.orders) + 1):
            if len(code) < n or len(code) < 3:
                break
            h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(1)
            if n in self.orders:
                found.append((((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64))
        if not found:
            return np.empty(0, np.int64)
        at = np.concatenate(found)
        order = np.arange(len(at), dtype=np.int32)
        self._mark[at] = order
        return at[self._mark[at] == order]
