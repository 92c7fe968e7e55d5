"""Hashed word shingles of whole texts, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
_POS = np.random.default_rng(77).integers(1, 1 << 63, 8, np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, as far as any text so far was long."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(_BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(_INVERSE, m, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """S with S[k] the sum of byte values times powers below k; see ``range_hash``."""
    up, _ = _POWERS.upto(len(codes) + 1)
    s = np.empty(len(codes) + 1, _U)
    s[0] = 0
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that depend on the bytes alone."""
    _, down = _POWERS.upto(len(s))
    return mix((s[end] - s[start]) * down[start])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word (A-Z lower-cased, split at the six ASCII spaces)."""
    if not text:
        return np.empty(0, _U)
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return range_hash(prefix_hash(codes), edge[::2], edge[1::2])


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct shingles of ``k`` words, sorted; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text)
    n = len(h)
    if not n:
        return h
    if n < k:
        # The length and the place of each word are part of the hash.
        return mix(mix(h * _POS[:n] if n <= len(_POS) else h * mix(np.arange(n, dtype=_U))).sum(keepdims=True, dtype=_U) + _U(n))
    s = h[: n - k + 1] * _POS[0]
    for j in range(1, k):
        s = s + h[j : n - k + 1 + j] * (_POS[j % 8] + _U(2 * (j // 8)))
    return np.unique(mix(s))
