"""Records of big delimited files, split into ranges although quoted fields may hold line breaks.

Whether a range of a file starts inside a quoted field depends on everything before it, but only as one
bit. A first pass counts the quotes of every range; the parity of all ranges before one says whether it
starts open. In a second pass each range then starts at its first true record. A record that runs over
the end of a range is left in fragments, at most two a range, which are put together by file and place.
Only ranges that start or end open are read a third time for them; usually there is none.

Lines are handed to Python in Arrow batches to be cut into records; batches without a break inside
quotes go through as they are. Quotes are the same byte in all charsets of the public files.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Ship the functions themselves to the executors, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RECORDS = pa.schema([("path", pa.string()), ("first", pa.bool_()), ("record", pa.binary())])
_FRAGMENTS = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("tail", pa.bool_()), ("record", pa.binary())]
)
# (path, start of a range) -> whether it starts and whether it ends inside a quoted field
Ranges = dict[tuple[str, int], tuple[bool, bool]]


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )


def quote_parity(lines: DataFrame) -> Ranges:
    """The state at both ends of every range; one entry for each split of the scan."""
    text = F.col("line").cast("string")
    quotes = F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))
    ranges = lines.groupBy("path", "start").agg(F.sum(quotes).alias("n"))
    upto = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    found: Ranges = {}
    ends: dict[str, tuple[int, bool]] = {}
    for row in ranges.withColumn("all", F.sum("n").over(upto)).collect():
        before, after = (row["all"] - row["n"]) % 2 == 1, row["all"] % 2 == 1
        found[row["path"], row["start"]] = before, after
        ends[row["path"]] = max(ends.get(row["path"], (-1, False)), (row["start"], after))
    unbalanced = sorted(path for path, (_, after) in ends.items() if after)
    if unbalanced:
        raise ValueError(f"unbalanced quotes in {', '.join(unbalanced[:5])}")
    return found


@dataclass
class _Range:
    """How far the lines of one range are cut into records."""

    path: str
    start: int
    open: bool
    head: bool  # still in a record that an earlier range began
    first: bool  # the next record is the file's first
    pending: list[bytes] = field(default_factory=list)


def _cut(
    state: _Range, lines: pa.Array
) -> tuple[pa.Array, list[bytes], list[bytes]]:
    """Whole one-line records, whole records of several lines, and lines of an earlier range's record."""
    odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
    if not state.open and not odd.any():
        return lines, [], []
    after = (np.cumsum(odd) + state.open) % 2 == 1
    ends = np.flatnonzero(~after)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    single = starts == ends
    single[:1] &= not state.pending and not state.head
    several, head = [], []
    for a, b in zip(starts[~single].tolist(), ends[~single].tolist(), strict=True):
        part = lines.slice(a, b + 1 - a).to_pylist()
        if state.head:
            head, state.head = part, False
        else:
            several.append(b"\n".join(state.pending + part))
            state.pending = []
    rest = lines.slice(int(ends[-1]) + 1 if len(ends) else 0).to_pylist()
    if state.head:
        head = rest
    else:
        state.pending += rest
    state.open = bool(after[-1])
    return lines.take(pa.array(ends[single])), several, head


def _walk(
    batches: Iterator[pa.RecordBatch],
    ranges: Ranges,
    inside: Callable[[_Range, pa.Array], pa.RecordBatch | None],
    at_end: Callable[[_Range], pa.RecordBatch | None],
) -> Iterator[pa.RecordBatch]:
    """The lines of each range in order; a range ends where the next one begins."""
    state = None

    def close(done: _Range | None) -> Iterator[pa.RecordBatch]:
        if done is not None:
            if done.open != ranges[done.path, done.start][1]:
                raise RuntimeError(f"ranges of {done.path} changed between two passes")
            if (out := at_end(done)) is not None:
                yield out

    for batch in batches:
        starts = batch.column(1).to_numpy()
        paths = batch.column(0).dictionary_encode().indices.to_numpy()
        change = (starts[1:] != starts[:-1]) | (paths[1:] != paths[:-1])
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), len(starts)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            path, start = batch.column(0)[a].as_py(), int(starts[a])
            if state is None or (state.path, state.start) != (path, start):
                yield from close(state)
                if (path, start) not in ranges:
                    raise RuntimeError(f"ranges of {path} changed between two passes")
                before = ranges[path, start][0]
                state = _Range(path, start, before, before, start == 0)
            if (out := inside(state, batch.column(2).slice(a, b - a))) is not None:
                yield out
    yield from close(state)


def _whole_records(ranges: Ranges):
    def inside(state: _Range, lines: pa.Array) -> pa.RecordBatch:
        # the file's first record, if it ends here, is its first line or the first of several lines
        plain = not state.pending and lines[0].as_py().count(b'"') % 2 == 0
        one, several, _ = _cut(state, lines)
        records = pa.concat_arrays([pa.array(several, pa.binary()), one]) if several else one
        first = np.zeros(len(records), bool)
        if state.first and len(records):
            first[len(several) if plain else 0], state.first = True, False
        return pa.record_batch([pa.array([state.path] * len(records), pa.string()), pa.array(first), records], schema=_RECORDS)

    return lambda batches: _walk(batches, ranges, inside, lambda _: None)


def _fragments(ranges: Ranges):
    def inside(state: _Range, lines: pa.Array) -> pa.RecordBatch | None:
        _, _, head = _cut(state, lines)
        return _fragment(state, False, head) if head else None

    def at_end(state: _Range) -> pa.RecordBatch | None:
        return _fragment(state, True, state.pending) if state.pending else None

    return lambda batches: _walk(batches, ranges, inside, at_end)


def _fragment(state: _Range, tail: bool, lines: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch([[state.path], [state.start], [tail], [b"\n".join(lines)]], schema=_FRAGMENTS)


def _joined(fragments: DataFrame) -> DataFrame:
    """Records out of fragments: the end of one range, whole ranges, the beginning of another."""
    order = Window.partitionBy("path").orderBy("start", "tail", "part")
    numbered = fragments.withColumn("n", F.sum(F.col("tail").cast("int")).over(order))
    pieces = F.sort_array(F.collect_list(F.struct("start", "tail", "part", F.decode("record", "ISO-8859-1").alias("t"))))
    whole = numbered.groupBy("path", "n").agg(pieces.alias("p"))
    text = F.array_join(F.col("p.t"), "\n")
    return whole.select("path", F.lit(False).alias("first"), F.encode(text, "ISO-8859-1").alias("record"))


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(path, first, record)``: every record of the files as bytes, blank lines left out.

    ``first`` marks the first record of each file, which must end within its first range. Line breaks
    are ``\\n``; a ``\\r`` before one stays. A file with an unbalanced quote is an error.
    """
    lines = _lines(spark, paths)
    ranges = quote_parity(lines)
    shared = spark.sparkContext.broadcast(ranges)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _whole_records(shared.value)(batches)

    records = lines.mapInArrow(whole, "path string, first boolean, record binary")
    touched = {key: state for key, state in ranges.items() if any(state)}
    if touched:

        def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _fragments(touched)(batches)

        # one row for each split of the scan at most; a broadcast leaves the lines in their order
        keys = F.broadcast(spark.createDataFrame(list(touched), "path string, start long"))
        near = lines.join(keys, ["path", "start"], "left_semi").select("path", "start", "line")
        fragments = near.mapInArrow(broken, "path string, start long, tail boolean, record binary")
        fragments = fragments.withColumn("part", F.monotonically_increasing_id())
        records = records.unionByName(_joined(fragments))
    return records.filter(~F.col("record").cast("string").isin("", "\r"))
