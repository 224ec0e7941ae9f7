"""Words and word shingles of a batch of texts as arrays.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII
characters; in UTF-8 that is a rule on single bytes, so one pass over the
joined bytes of a batch finds the words of all its texts.  Hashes are 64-bit
polynomials over random byte values, finished with a mixer; they do not depend
on the batch, the process or the platform.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(base: U, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, dtype=U)
        held[0] = 1
        np.cumprod(held, out=held)
        _POWERS[int(base)] = held
    return held[:n]


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, joined, and its n + 1 offsets (nulls are empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    start: np.ndarray  # byte positions in the joined bytes
    end: np.ndarray
    first: np.ndarray  # index of each text's first word; n + 1 entries
    hash: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    inside = IS_WORD[low]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # words do not cross texts
    if len(data):
        start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    else:
        start = end = np.zeros(0, np.int64)
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(VALUES[low] * powers(BASE, len(data)), out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start] + (end - start).astype(U))
    return Words(start, end, np.searchsorted(start, offsets), hashed)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and each text's first window (n + 1)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    rolled = hashes[:n - k + 1].copy()
    for i in range(1, k):
        rolled = mix(rolled * BASE + hashes[i:n - k + 1 + i])
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    begins = np.concatenate(([0], np.cumsum(counts)))
    keep = np.repeat(first[:-1] - begins[:-1], counts) + np.arange(begins[-1])
    return rolled[keep], begins
