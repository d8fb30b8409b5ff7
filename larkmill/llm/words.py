"""Words of many texts at once as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes from which on a word is hashed by a digest: sums modulo 2^64 can be equal for long words of a certain pattern.
LONG = 64
_GAPS = np.zeros(256, bool)
_GAPS[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers whose results look random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE, inverse: int = _INVERSE) -> np.ndarray:
    """Polynomial hash modulo 2^64 of values[start:end] for each pair, by differences of one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts]


def hash_words(texts: Sequence[bytes], lower: bool = False, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, bytes]]:
    """(hashes of all words in order, bounds of each text's words, -, (starts, ends, joined bytes)).

    Words are what bytes.split() gives; lower: A-Z count as a-z. Equal words have equal hashes in every process; unequal ones
    differ but for chance (2^-64 a pair; less with those of a second base). The words of text i are hashes[bounds[i]:bounds[i + 1]].
    """
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    gap = _GAPS[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    bounds = np.searchsorted(starts, first, "left")
    bytes_ = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    hashes = scramble(rolling(bytes_, starts, ends, base, pow(base, -1, 1 << 64)) + (ends - starts).astype(np.uint64)) if len(starts) else np.empty(0, np.uint64)
    for i in np.flatnonzero(ends - starts > LONG):
        word = joined[starts[i] : ends[i]]
        hashes[i] = int.from_bytes(blake2b(word.lower() if lower else word, digest_size=8, key=base.to_bytes(8, "little")).digest(), "little")
    return hashes, bounds, first, (starts, ends, joined)
