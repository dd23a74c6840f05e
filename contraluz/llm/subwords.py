"""Hashed character n-grams of words, computed for many words at once."""

from __future__ import annotations

import numpy as np

_EDGE = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word index, bucket)`` of every character n-gram of the words, a mark at both ends.

    ``buckets`` is a power of two.
    """
    mark = chr(_EDGE)
    line = mark + mark.join(words) + mark
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = codes == _EDGE
    owner = np.cumsum(edge) - 1  # a mark belongs to the word it opens
    shift = np.uint64(64 - buckets.bit_length() + 1)
    of, bucket = [], []
    inner = np.concatenate([[0], np.cumsum(edge)])
    for n in range(low, high + 1):
        count = len(codes) - n + 1
        if count <= 0:
            break
        value = np.full(count, np.uint64(n))
        for k in range(n):
            value = value * _MIX + codes[k : k + count]
        # no mark strictly inside
        valid = inner[n - 1 : n - 1 + count] == inner[1 : 1 + count]
        if n == 1:
            valid = ~edge[:count]
        at = np.flatnonzero(valid)
        of.append(owner[at])
        bucket.append(((value[at] * _MIX) >> shift).astype(np.int64))
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, bucket = np.concatenate(of), np.concatenate(bucket)
    inside = of < len(words)
    return of[inside], bucket[inside]


def word_buckets(words: list[str], buckets: int) -> np.ndarray:
    """Bucket of each whole word."""
    mark = chr(_EDGE)
    line = "".join(w + mark for w in words)
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.flatnonzero(codes == _EDGE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    # a polynomial in the place from the end; the marks close each word
    place = np.repeat(ends, ends - starts + 1) - np.arange(len(codes))
    power = np.cumprod(np.full(max(int(place.max(initial=0)) + 1, 1), _MIX | np.uint64(1)))
    value = np.add.reduceat(codes * power[place], starts) if len(starts) else codes
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return ((value * _MIX) >> shift).astype(np.int64)
