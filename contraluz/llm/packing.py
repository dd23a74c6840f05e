"""Best-fit packing of token sequences by bin completion (operator 10).

Documents are tokenised and cut where they stand; only lengths travel. How many pieces there are of
each length (at most 2048 numbers, whatever the corpus) is the packing problem. It is solved by bin
completion: take the largest length left, list the undominated fillings of the room beside it,
fewest wasted tokens first, and branch over them; a branch whose waste already exceeds what the best
known solution allows is cut. The first incumbents are best-fit solutions. A filling is repeated as
often as its lengths last, so the search works on the table of lengths and not on pieces. Each
length's slots are then dealt to its pieces by their rank.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.common import checkpointed
from contraluz.llm.ranking import global_rank

CAPACITY = 2048
END = 0
FILLINGS = 4
NODES = 6_000
_TEXTS_AT_ONCE = 128  # whose pieces a task holds before it hands them on

# tokenising

# The usual rule that cuts a text before byte-level merging, written without backtracking. Texts with
# characters beyond Latin and common punctuation go to the tokenizer itself, so that no difference in
# Unicode versions between two libraries can show.
_RULE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_COMMON = re.compile("[\0-\x1b\x20-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")


def _merger(path: str):
    """The file's merges as a ``tiktoken`` encoding, or None if they are of another kind."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    if (content.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["type"] != "BPE":
        return None
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    letters = sorted(ByteLevel.alphabet(), key=vocabulary.__getitem__)
    if [vocabulary[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))) or [
        vocabulary[c] for c in letters
    ] != list(range(256)):
        return None
    # the fixed byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = [*letters, *(a + b for a, b in pairs)]
    ranks = {bytes(byte[c] for c in token): i for i, token in enumerate(tokens)}
    return tiktoken.Encoding(
        "merges", pat_str=_RULE, mergeable_ranks=ranks, special_tokens={}
    )


class TokenIds:
    """Token ids of texts as little-endian 32-bit bytes.

    Byte-level merges are run by ``tiktoken`` with the ranks of the same file, several times faster,
    if the file is of that kind and its merges stand in the order of their ids. Otherwise, and for
    texts that hold a special token or uncommon characters, the tokenizer itself encodes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merger = _merger(path)

    def __call__(self, text: str) -> bytes:
        if self.merger and _COMMON.fullmatch(text) and not any(s in text for s in self.specials):
            ids = self.merger.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all full but the first, which may be shorter."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total], strict=True)]


_PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
)


_PIECE_ARROW = pa.list_(
    pa.struct(
        [
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
            ("ids", pa.binary()),
        ]
    )
)


@lru_cache(maxsize=1)
def _token_ids(path: str) -> TokenIds:
    """One encoder a worker process, whatever number of tasks it runs."""
    return TokenIds(path)


def _pieces_udf(path: str, capacity: int, keep_ids: bool):
    @F.arrow_udf(_PIECE)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, end = _token_ids(path), np.array([END], "<u4").tobytes()
        for texts in batches:
            for at in range(0, len(texts), _TEXTS_AT_ONCE):
                rows = []
                for text in texts.slice(at, _TEXTS_AT_ONCE):
                    ids = encode(text.as_py() or "") + end
                    row = []
                    for i, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        row.append((i, start, length, zlib.crc32(part), part if keep_ids else None))
                    rows.append(row)
                yield pa.array(rows, _PIECE_ARROW)

    return pieces


def tokenised(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    keep_ids: bool = False,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every piece, with its ids on request.

    A document is its token ids and an end id; null texts are empty. ``ids`` are little-endian
    32-bit numbers.
    """
    found = _pieces_udf(tokenizer, capacity, keep_ids)(F.col(text))
    rows = docs.select(F.col(id_column).alias("id"), F.explode(found).alias("p")).select("id", "p.*")
    return rows if keep_ids else rows.drop("ids")


# solving


@dataclass
class Pattern:
    """Lengths that share a sequence, and how many sequences are filled alike."""

    lengths: tuple[int, ...]
    times: int


@dataclass
class Solution:
    patterns: list[Pattern] = field(default_factory=list)
    bins: int = 0


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's second bound)."""
    lengths = np.arange(len(counts))
    n, tokens = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * lengths)[::-1])[::-1]
    n, tokens = np.append(n, 0), np.append(tokens, 0)
    half, best = capacity // 2, -(-int(tokens[0]) // capacity)
    for k in range(half + 1):
        large, big = int(n[capacity - k + 1]), int(n[half + 1])
        middle = big - large
        room = middle * capacity - int(tokens[half + 1] - tokens[capacity - k + 1])
        small = int(tokens[k] - tokens[half + 1])
        best = max(best, big + max(0, -(-(small - room) // capacity)))
    return best


def dominated(filling: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether ``other`` (descending, like ``filling``) is as good a choice in every case.

    It is if the items of ``filling`` can be dealt to places as large as the items of ``other``;
    checked for single items and for one small group of the smallest items.
    """
    if filling == other or len(other) > len(filling):
        return False
    head = len(other) - 1
    return all(a <= b for a, b in zip(filling, other, strict=False)) and (
        not other or sum(filling[head:]) <= other[-1]
    )


def fillings(counts: np.ndarray, room: int, width: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with up to three pieces and then best fit, best first."""
    lengths = np.flatnonzero(counts[: room + 1])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return [()]
    one = sum(1 << int(v) for v in lengths)
    full = (1 << (room + 1)) - 1
    if one >> room & 1:
        return [(room,)]  # fills the room with one piece: dominates every other filling
    two = 0
    for v in lengths:
        two |= one << int(v)
    two &= full
    three = 0
    if not two >> room & 1:
        for v in lengths:
            three |= two << int(v)
        three &= full
    found: list[tuple[int, ...]] = []
    reach, descending = one | two | three, [int(v) for v in lengths[::-1]]
    while reach and len(found) < width:
        total = reach.bit_length() - 1
        reach ^= 1 << total
        for filling in _made_of(total, descending, counts, one, two)[:2]:
            left = room - sum(filling)
            rest, used = [], {v: filling.count(v) for v in filling}
            while left > 0:
                fit = next((v for v in descending if v <= left and counts[v] > used.get(v, 0)), 0)
                if not fit:
                    break
                rest.append(fit)
                used[fit] = used.get(fit, 0) + 1
                left -= fit
            whole = tuple(sorted((*filling, *rest), reverse=True))
            if whole not in found and not any(dominated(whole, f) for f in found):
                found.append(whole)
    found.sort(key=lambda f: (-sum(f), len(f)))
    return found[:width]


def _made_of(
    total: int, descending: list[int], counts: np.ndarray, one: int, two: int
) -> list[tuple[int, ...]]:
    """Up to two ways to make ``total`` of one to three pieces, largest pieces first."""
    out: list[tuple[int, ...]] = []
    if one >> total & 1:
        out.append((total,))
    if two >> total & 1:
        for a in descending:
            b = total - a
            if 0 < b <= a and one >> b & 1 and (a != b or counts[a] > 1):
                out.append((a, b))
                break
    if not out:
        for a in descending:
            rest = total - a
            if rest <= 0 or not two >> rest & 1:
                continue
            for b in descending:
                c = rest - b
                if b <= a and 0 < c <= b and one >> c & 1:
                    if all(counts[v] >= (a, b, c).count(v) for v in (a, b, c)):
                        out.append((a, b, c))
                        break
            if out:
                break
    return out


def best_fit(counts: np.ndarray, capacity: int) -> Solution:
    """Best-fit decreasing on the table of lengths."""
    room, out = counts.copy(), Solution()
    while True:
        top = int(np.flatnonzero(room)[-1]) if room.any() else 0
        if not top:
            return out
        pattern, left, used = [top], capacity - top, {top: 1}
        while left > 0:
            fits = np.flatnonzero(room[1 : left + 1]) + 1
            fit = next((int(v) for v in fits[::-1] if room[v] > used.get(int(v), 0)), 0)
            if not fit:
                break
            pattern.append(fit)
            used[fit] = used.get(fit, 0) + 1
            left -= fit
        _take(room, out, tuple(pattern), used)


def _take(room: np.ndarray, out: Solution, pattern: tuple[int, ...], used: dict[int, int]) -> int:
    times = min(int(room[v]) // n for v, n in used.items())
    for v, n in used.items():
        room[v] -= times * n
    out.patterns.append(Pattern(pattern, times))
    out.bins += times
    return times


def solve(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> Solution:
    """Patterns that hold all pieces; ``counts[n]`` is the number of pieces of length ``n``.

    Depth first over the fillings of the largest length left, least waste first. A branch is cut when
    its waste leaves no way to beat the incumbent; the search ends at the lower bound or after
    ``nodes`` fillings, and always has a whole solution: best fit, or better.
    """
    total = int((counts * np.arange(len(counts))).sum())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    seen = 0
    # a path is (room left, solution so far, waste so far, fillings still to try)
    path: list[tuple[np.ndarray, Solution, int, list[tuple[int, ...]]]] = []

    def enter(room: np.ndarray, so_far: Solution, waste: int) -> None:
        top = int(np.flatnonzero(room)[-1])
        less = room.copy()
        less[top] -= 1
        choices = [tuple((top, *f)) for f in fillings(less, capacity - top)]
        path.append((room, so_far, waste, choices[::-1]))

    if counts.any() and best.bins > bound:
        enter(counts.copy(), Solution(), 0)
    while path and seen < nodes and best.bins > bound:
        room, so_far, waste, choices = path[-1]
        if not choices:
            path.pop()
            continue
        pattern = choices.pop()
        seen += 1
        room, out = room.copy(), Solution(list(so_far.patterns), so_far.bins)
        times = _take(room, out, pattern, {v: pattern.count(v) for v in pattern})
        wasted = waste + times * (capacity - sum(pattern))
        if wasted > (best.bins - 1) * capacity - total:
            continue
        if not room.any():
            if out.bins < best.bins:
                best = out
            continue
        enter(room, out, wasted)
    return best


@dataclass
class Slots:
    """Where the pieces of each length go: ranks from ``first`` on go to successive sequences."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, solution: Solution) -> Slots:
        rows, used, sequence = [], {}, 0
        for pattern in solution.patterns:
            offset = 0
            for length in pattern.lengths:
                first = used.get(length, 0)
                rows.append((length, first, sequence, offset))
                used[length] = first + pattern.times
                offset += length
            sequence += pattern.times
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        return cls(*table.T)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces given by length and rank within the length."""
        low = np.searchsorted(self.length, length, side="left")
        high = np.searchsorted(self.length, length, side="right")
        while (high - low > 1).any():  # the last slot whose first rank is not above the piece's
            middle = (low + high) // 2
            under = self.first[np.minimum(middle, len(self.first) - 1)] <= rank
            low, high = np.where(under, middle, low), np.where(under, high, middle)
            low, high = np.minimum(low, high - 1), np.maximum(high, low + 1)
        return self.sequence[low] + rank - self.first[low], self.offset[low]


_PLACE = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _place_udf(slots: Slots):
    @F.pandas_udf(_PLACE)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        if not len(length):
            return pd.DataFrame({"sequence_id": [], "offset": []}, dtype="int64")
        sequence, offset = slots.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (with ``id``, ``piece``, ``length``) with ``sequence_id`` and ``offset``.

    The driver sees one count for each length and the patterns made of them, whose number depends on
    the capacity and not on the data. Equal pieces get different places. Nothing is dropped.
    """
    pieces = checkpointed(pieces)
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = Slots.of(solve(counts, capacity, nodes))
    ranked, _ = global_rank(pieces, ["length", "id", "piece"], name="_rank")
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    there = np.flatnonzero(counts)
    starts = pieces.sparkSession.createDataFrame(pa.table({"_n": there, "_before": before[there]}))
    ranked = ranked.join(F.broadcast(starts), F.col("length") == F.col("_n"))  # a row a length
    placed = _place_udf(slots)(F.col("length"), F.col("_rank") - F.col("_before"))
    return ranked.withColumn("_place", placed).select(*pieces.columns, "_place.*")


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    nodes: int = NODES,
) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and offset.

    Null and empty texts are a piece of one end id. Repeated rows are packed as often as they occur;
    rows without id take part. An empty table gives no rows.
    """
    return pack_pieces(tokenised(docs, tokenizer, id_column, text, capacity), capacity, nodes)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, input_ids, lengths)``: the packed sequences themselves.

    Ids of ``docs`` must be unique and not null. A group holds one sequence, ``capacity`` ids at most.
    """
    parts = tokenised(docs, tokenizer, capacity=capacity, keep_ids=True).select("id", "piece", "ids")
    rows = packed.join(parts, ["id", "piece"]).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts")
    )

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def joined(batch: pd.Series) -> pd.Series:
        return pd.Series(
            [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch]
        )

    return rows.select(
        "sequence_id", joined("parts").alias("input_ids"), F.col("parts.length").alias("lengths")
    )
