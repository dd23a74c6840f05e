"""Benchmark passages inside documents by Wu-Manber multi-pattern search (operator 7).

The alphabet is words: a text is its sequence of words, a pattern a window of benchmark words. For
patterns of m words, a shift table tells how far the window end may jump on seeing the block of two
words that ends there (m - 1 if no pattern has that block). Where the shift is 0, the block is the
suffix of some patterns; the bucket of that suffix holds them and words are compared directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.common import checkpointed, free_name

WINDOW = 10
MAX_PATTERN_WORDS = 2_000_000
# bytes that end a word; capitals are lowered by the same table
_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b)
    if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122
    else 32
    for b in range(256)
)

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(_SPAN)),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits, ASCII capitals lowered; every non-ASCII character is a letter."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Patterns of one length in words, each with the items that contain it."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.m = len(next(iter(patterns)))
        self.block = min(2, self.m)
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, items in patterns.items():
            for end in range(self.block, self.m + 1):
                key = self._key(words, end)
                room = self.m - end
                if room < self.shift.get(key, self.m - self.block + 1):
                    self.shift[key] = room
            self.bucket.setdefault(self._key(words, self.m), []).append((list(words), items))

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """``(start, items)`` of every occurrence."""
        m, most, get, end, n = self.m, self.m - self.block + 1, self.shift.get, self.m, len(words)
        single = self.block == 1
        while end <= n:
            key = words[end - 1] if single else (words[end - 2], words[end - 1])
            jump = get(key, most)
            if jump:
                end += jump
                continue
            start = end - m
            for pattern, items in self.bucket[key]:
                if words[start] == pattern[0] and words[start:end] == pattern:
                    yield start, items
            end += 1


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of ``size`` words; a shorter text is one window, no words give none."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def build(items: list[tuple[str, str | None]], size: int = WINDOW) -> list[WuManber]:
    """One searcher for each pattern length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        for window in windows(words_of(text), size):
            by_length.setdefault(len(window), {}).setdefault(window, set()).add(item)
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


def find(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit spans (start, stop) in words, and the items that occur."""
    spans, items = [], set()
    for searcher in searchers:
        for start, found in searcher.search(words):
            spans.append((start, start + searcher.m))
            items |= found
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _search_udf(searchers: list[WuManber]) -> Callable:
    @F.pandas_udf(RESULT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = words_of(text)
                spans, items = find(words, searchers)
                rows.append(
                    (
                        len(words),
                        sum(b - a for a, b in spans),
                        sorted(items),
                        [{"start": a, "stop": b} for a, b in spans],
                    )
                )
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    return search


@F.pandas_udf(RESULT)
def _both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Union of what two parts of the benchmark found in the same text."""
    rows = []
    for a, b in zip(left.itertuples(index=False), right.itertuples(index=False), strict=True):
        spans = merged([(s["start"], s["stop"]) for s in (*a.spans, *b.spans)])
        rows.append(
            (
                a.n_words,
                sum(stop - start for start, stop in spans),
                sorted({*a.items, *b.items}),
                [{"start": start, "stop": stop} for start, stop in spans],
            )
        )
    return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])


def _parts(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[list]:
    """The benchmark in parts of at most ``most`` pattern words (one item at least)."""
    part, size = [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        words = len(words_of(row["t"])) * WINDOW
        if part and size + words > most:
            yield part
            part, size = [], 0
        part.append((row["i"] if row["i"] is not None else "", row["t"]))
        size += words
    if part:
        yield part


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    item: str = "item_id",
    text: str = "text",
    name: str = "hits",
    max_pattern_words: int = MAX_PATTERN_WORDS,
) -> DataFrame:
    """``docs`` with a struct column ``name``: words, hit words, items found, hit spans.

    Documents are read once and never shuffled. The patterns travel to the tasks in parts of bounded
    size; a benchmark beyond one part is searched part by part, and what the parts find is united.
    Null texts have no words; an item without id counts as item ''. An item of fewer than 10 words is
    one pattern. Repeated items count once by id. An empty benchmark hits nothing.
    """
    out, after = None, free_name("next", [*docs.columns, name])
    for part in _parts(benchmark, item, text, max_pattern_words):
        found = _search_udf(build(part))(F.col(text))
        if out is None:
            out = docs.withColumn(name, found)
        else:
            out = checkpointed(out.withColumn(after, found))
            out = out.withColumn(name, _both(name, after)).drop(after)
    return docs.withColumn(name, _search_udf([])(F.col(text))) if out is None else out


def items_digest(items: str) -> F.Column:
    """Hex SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.col(items))), 256)
