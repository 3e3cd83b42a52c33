"""Vectorised words, shingles and 64-bit hashes over Arrow string columns (UTF-8 bytes, no Python strings)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SHIFTS = tuple(U64(x) for x in (30, 27, 31))
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> _SHIFTS[0])) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _SHIFTS[1])) * U64(0x94D049BB133111EB)
    return x ^ (x >> _SHIFTS[2])


#: ASCII upper case to lower case, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: A random 64-bit value for each byte, and a second family of them.
BYTE_VALUES = tuple(mix(np.arange(256, dtype=np.uint64) + U64(seed)) for seed in (0x51F7, 0xC0FFEE))

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i up to n."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        made = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(size + 1, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if size > 1 << 22:  # of a very long text: not kept
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


class Rolling:
    """Hashes of any substring from one prefix pass: (P[e] - P[s]) * B**-s."""

    def __init__(self, data: np.ndarray, family: int = 0):
        power, self.inverse = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[family][data] * power[: len(data)], out=self.prefix[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some rows: starts and ends in bytes, bounds by row, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, of: np.ndarray = NOT_SPACE, lower: bool = True):
        low = LOWER[data] if lower else data
        word = np.zeros(len(low) + 2, dtype=bool)
        word[1:-1] = of[low]
        inside = word[1:-1]
        start, end = inside & ~word[:-2], inside & ~word[2:]
        full = offsets[:-1] < offsets[1:]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        start[first] = inside[first]
        end[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = Rolling(low).of(self.starts, self.ends) if len(low) else np.zeros(0, dtype=np.uint64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words; those that cross rows are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * U64(0xFF51AFD7ED558CCD) + hashes[i : i + n]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, of: np.ndarray = NOT_SPACE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; fewer words make one shingle; no words, none."""
    for i, j in slices(offsets, 1 << 20):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], of)
        all_of = shingles(words.hashes, k)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(all_of[a : b - k + 1])
            elif b > a:
                yield mix(shingles(words.hashes[a:b], int(b - a)) + U64(int(b - a)))
            else:
                yield np.zeros(0, dtype=np.uint64)
