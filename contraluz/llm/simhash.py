"""Near-duplicates by SimHash fingerprints and pivot distance tables (operator 3).

Method. Each text becomes a 64-bit fingerprint of its word shingles. For each fingerprint the
Hamming distances to ``PIVOTS`` fixed reference fingerprints are tabulated. Two fingerprints at
distance d differ by at most d in every column of that table, so a pair whose largest coordinate
difference exceeds the limit is discarded without looking at its bits; survivors are verified.

Which pairs meet at all is dealt out by an exact key, as a pivot table alone could only be searched
by comparing everything with everything: of five blocks of bits, three differing bits leave two
untouched, so a linked pair agrees on one of the ten pairs of blocks. A key that very many distinct
fingerprints share is cut into blocks, and each pair of blocks is a cell of its own. A cell gives
back a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.common import checkpointed, shuffle_partitions
from contraluz.llm.components import connected_components

SEED = 42
WIDTH = 3
LIMIT = 3
PIVOTS = 24
CELL = 1024
_BITS = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
_SHINGLES_AT_ONCE = 1 << 15
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def pivot_table(fingerprints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot."""
    return np.bitwise_count(fingerprints[:, None] ^ pivots[None, :]).astype(np.int8)


def reference_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, count, dtype=np.uint64)


def fingerprint_text(text: str | None, width: int = WIDTH) -> int:
    """Unsigned fingerprint of a text; 0 if it has no words.

    ASCII capitals are lowered and words are cut at ASCII white space (both as ``bytes`` does it).
    A bit is set if it is set in over half the shingles' hashes, repeated shingles counted each time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(line)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        hashes = [
            digest(line[s:e], SEED)
            for s, e in zip(
                starts[at : at + _SHINGLES_AT_ONCE], ends[at : at + _SHINGLES_AT_ONCE], strict=True
            )
        ]
        octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
        # how often each byte value occurs at each place says how often each bit is set
        counts += np.concatenate([np.bincount(o, minlength=256) @ _BITS_OF_BYTE for o in octets.T])
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([_signed(fingerprint_text(text)) for text in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp)`` of every row: the fingerprint as a signed long. Null texts have no words."""
    return docs.select(F.col(id_column).alias("id"), _fingerprint(F.col(text)).alias("fp"))


def _mask(pair: tuple[int, int]) -> int:
    return _signed(sum(((1 << hi) - 1) & ~((1 << lo) - 1) for lo, hi in (_BITS[i] for i in pair)))


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the classes that the pairs connect; a class is named by its smallest member."""
    roots = np.unique(np.stack([label[left], label[right]], 1), axis=0)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    for a, b in roots.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    if not parent:
        return label
    names = np.arange(len(label))
    for x in parent:
        names[x] = find(x)
    return names[label]


def linked_forest(
    fps: np.ndarray, table: np.ndarray, side: np.ndarray, limit: int = LIMIT
) -> tuple[np.ndarray, int, int]:
    """Class of each member of a cell, and how many pairs survived the table and the check.

    ``side`` is the block a member came from: in a cell of two blocks only pairs across are looked
    at, as each block also meets itself in a cell of its own.
    """
    n, label = len(fps), np.arange(len(fps))
    survived = linked = 0
    across = side.min() != side.max()
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0].astype(np.int16)
    reach = np.searchsorted(first, first + limit, side="right")
    step = max(1, min(256, (1 << 18) // n))
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        sizes = reach[rows] - rows - 1
        if not sizes.any():
            continue
        left = np.repeat(rows, sizes)
        right = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + left + 1
        left, right = order[left], order[right]
        keep = label[left] != label[right]
        if across:
            keep &= side[left] != side[right]
        left, right = left[keep], right[keep]
        for column in range(1, table.shape[1]):
            if not len(left):
                break
            keep = np.abs(table[left, column] - table[right, column]) <= limit
            left, right = left[keep], right[keep]
        survived += len(left)
        keep = np.bitwise_count(fps[left] ^ fps[right]) <= limit
        left, right = left[keep], right[keep]
        linked += len(left)
        if len(left):
            label = _merge(label, left, right)
    return label, survived, linked


_KEYS = ["t", "key", "lo", "hi"]
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell in, links out; a cell that is cut by a batch end waits for the next."""
    pivots = reference_fingerprints()
    rest: list[np.ndarray] | None = None

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        change = np.zeros(len(columns[0]), bool)
        change[0] = True
        for column in columns[:4]:
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, len(change)))
        left, right = [], []
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            ids, side = columns[5][start : start + size], columns[6][start : start + size]
            fps = columns[4][start : start + size].view(np.uint64)
            by = np.argsort(ids, kind="stable")  # so that the smallest member names the class
            ids = ids[by]
            label, _, _ = linked_forest(fps[by], pivot_table(fps[by], pivots), side[by])
            hung = np.flatnonzero(label != np.arange(size))
            left.append(ids[hung])
            right.append(ids[label[hung]])
        empty = [np.zeros(0, np.int64)]
        return pa.record_batch(
            [np.concatenate(left or empty), np.concatenate(right or empty)], schema=_EDGES
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns, strict=True)]
        last = len(columns[0]) - 1
        same = np.ones(last + 1, bool)
        for column in columns[:4]:
            same &= column == column[last]
        cut = last + 1 - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield links([column[:cut] for column in columns])
        rest = [column[cut:] for column in columns]
    if rest is not None:
        yield links(rest)


def near_links(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links ``(a, b)`` that span the near-duplicates among distinct fingerprints ``(id, fp)``."""
    tables = [_mask(pair) for pair in combinations(range(5), 2)]
    keyed = nodes.select(
        "id",
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("t", "key"),
    )
    hot = (
        keyed.groupBy("t", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > cell)
        .select("t", "key", F.ceil(F.col("n") / cell).cast("int").alias("g"))
    )
    dealt = (
        keyed.join(hot, ["t", "key"], "left")
        .withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"), F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)))
        .select(
            "t",
            "key",
            F.least("own", "other").alias("lo"),
            F.greatest("own", "other").alias("hi"),
            "fp",
            "id",
            "own",
        )
    )
    parts = shuffle_partitions(nodes.sparkSession)
    cells = dealt.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS)
    return cells.mapInArrow(_edges_of_cells, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, component)`` of every row: fingerprints that differ in at most 3 bits link.

    The component is the smallest id that can be reached. Rows without words share fingerprint 0 and
    link like any other. Rows without an id have a null component and link nothing. Repeated rows
    each come back. Exact copies share a fingerprint, so only one of them enters the search.
    """
    prints = checkpointed(fingerprints(docs, id_column, text))
    known = prints.where("id is not null")
    nodes = checkpointed(known.groupBy("fp").agg(F.min("id").alias("id")))
    parts = connected_components(near_links(nodes))
    named = nodes.join(parts, nodes["id"] == parts["a"], "left").select(
        "fp", F.coalesce("component", "id").alias("component")
    )
    return prints.join(named, "fp", "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group the row with the smallest id.

    Rows without an id stay. Of rows that repeat the kept id, all stay: they are one document.
    """
    groups = near_duplicates(docs, id_column, text)
    gone = groups.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
