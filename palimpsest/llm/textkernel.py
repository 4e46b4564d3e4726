"""Whole-text word hashing in numpy: texts become arrays of 64-bit word hashes without a Python loop over words.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; A-Z count as a-z. In UTF-8 every byte of a
non-ASCII character is 0x80 or more, so word bounds are found on bytes. A word's hash is a polynomial in its bytes,
taken from prefix sums (odd multiplier, so its powers have inverses modulo 2**64), then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers: list[np.ndarray] = [np.ones(0, U), np.ones(0, U)]


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, U(base))
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0], _powers[1]


class Words:
    """Words of some texts, in order. hashes: by word. first: index of each text's first word, with the total at the end.

    data: the lower-cased bytes; start, end: byte bounds by word.
    """

    def __init__(self, texts: list[str | None], unicode_lower: bool = False):
        parts = [(t.lower() if unicode_lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        raw = b"\n".join(parts) + b"\n"
        self.data = data = _LOWER[np.frombuffer(raw, np.uint8)]
        word = _IS_WORD[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        ends_at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        self.text_end = ends_at
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends_at)))
        if len(self.start):
            up, down = _power_tables(len(data))
            h = np.cumsum(_BYTE[data] * up[: len(data)], dtype=U)
            before = np.where(self.start > 0, h[self.start - 1], U(0))
            self.hashes = fmix((h[self.end - 1] - before) * down[self.start] + (self.end - self.start).astype(U))
        else:
            self.hashes = np.zeros(0, U)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes, by the run's first index (empty if fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= U(0xD6E8FEB86659FD93)
        acc += h[j : j + n]
    return fmix(acc + U(k))


def chunks(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts whose characters sum to about limit; a longer text stands alone, whole."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
