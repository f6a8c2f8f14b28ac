"""Word shingles as sorted arrays of 64-bit hashes, computed on Arrow buffers in bulk.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, with A-Z lower-cased. A word's hash is a sum over its bytes (a fixed random number for the
byte value, times a power of an odd number for the place in the word), mixed; a shingle's hash
mixes its words'. Different shingles have different hashes but for a chance of about 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240101)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = (_RNG.integers(0, 2**64, 256, np.uint64) | np.uint64(1))[_LOWER]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 16, np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)
#: Bytes worked on at a time: what numpy makes of them stays within a few megabytes.
SEGMENT = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of bytes, and where they begin. ``begin``: offsets at which a text begins."""
    space = _SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[begin[begin < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.zeros(len(data), np.int64)
    place[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(place)
    values = _VALUES[data] * _POWERS[place & 0xFFFF]
    far = np.flatnonzero(place > 0xFFFF)
    values[far] = mixed(values[far] + (place[far] >> 16).astype(np.uint64) * _ODD)
    values[space] = 0
    return mixed(np.add.reduceat(values, starts)), starts


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offsets of its texts (one more at the end); a null is empty."""
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def all_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and where each text's begin (one more at the end)."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + 4096)
            if len(gap):
                break
        near = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)]
        h, s = word_hashes(data[at:end], near - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles of ``n`` words; fewer words are one shingle, no words none.

    A run of texts of about ``SEGMENT`` bytes is worked on at a time.
    """
    data, offsets = texts_of(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SEGMENT, "right")) - 1)
        yield from _sets(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], n)
        begin = end


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    words, ends = all_words(data, offsets)
    whole = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        whole = mixed(whole * _ODD + words[k : k + len(whole)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            h = np.uint64(b - a)
            for w in words[a:b]:
                h = mixed(np.array([h], np.uint64) * _ODD + w)[0]
            yield np.array([h], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
