"""Alignment of two tokenizers over whole texts (operator 13).

Both cut the same bytes, so each token is known by where it ends. The shorter list of ends drives a
galloping search into the longer: from the last place found the step doubles until it passes the end
wanted, and a binary search settles the place within the last step. Ends found in both lists cut the
text into groups. The places of two neighbouring ends differ by how many tokens of the other side lie
between them, which gives each token its range of overlapping partners.

How often two ids are linked in the whole corpus is counted from what each document holds, as one
entry for each distinct pair: first within a task, then by a shuffle on the pair. The counts go back
to the documents in two ways with one result. The most frequent pairs, a fixed number of them, are
broadcast; the links of all other pairs, none of them hot, are joined. What is written between is
bounded by the links: five bytes for each distinct pair of a document.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.llm.common import checkpointed

FREQUENT = 1 << 18  # pairs that are broadcast
_HELD = 1 << 21  # distinct pairs a task holds before it hands on partial counts
_TEXTS_AT_ONCE = 64


def _byte_level() -> dict[str, int]:
    # the fixed byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Ids of a byte-level tokenizer file, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        from contraluz.llm.packing import _COMMON, _merger

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        self.merger, self.common = _merger(path), _COMMON
        byte, added = _byte_level(), self.tokenizer.get_added_tokens_decoder()
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            plain = i in added or any(c not in byte for c in token)
            self.bytes[i] = token.encode() if plain else bytes(byte[c] for c in token)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [
            self.merger.encode_ordinary(t) if self.merger and self.common.fullmatch(t) else None
            for t in texts
        ]
        left = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(left, self.tokenizer.encode_batch([texts[i] for i in left], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out


class Pieces:
    """Ids of a sentence-piece model, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [
            bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        ]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each of the ascending ``short``, how many of the ascending ``long`` are smaller."""
    out, low, n = [], 0, len(long)
    add = out.append
    for end in short:
        if low < n and long[low] < end:
            step = 1
            while low + step < n and long[low + step] < end:
                step += step
            low = bisect_left(long, end, low + (step >> 1) + 1, min(n, low + step))
        add(low)
    return out


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links as places ``(a, b)``, and which tokens of either side end a group.

    Both lists ascend strictly and have the same last end.
    """
    swap = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if swap else (ends_a, ends_b)
    rank = np.array(gallop(short.tolist(), long.tolist()), np.int64)
    common = long[rank] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = rank[:-1] + common[:-1]  # a partner that ends where the last token ended is behind
    width = rank - first + 1
    left = np.repeat(np.arange(len(short)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width - first, width)
    ends_group = np.zeros(len(long), bool)
    ends_group[rank[common]] = True
    return (right, left, ends_group, common) if swap else (left, right, common, ends_group)


@dataclass
class Aligned:
    groups: int
    links: int
    text: bytes
    pairs: np.ndarray
    counts: np.ndarray


class Aligner:
    """Two tokenizers, and the alignment of one text's ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.n_b = len(self.b.bytes)
        self.kind = pair_kind(len(self.a.bytes), self.n_b)
        # how an id is written: inside its group, and as the last of its side
        marks = ((self.a.bytes, b"|"), (self.b.bytes, b";"))
        names = [b"%d%b" % (i, end) for side, last in marks for end in (b",", last) for i in range(len(side))]
        self.names = np.array(names, object)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of either side; none where a text is empty or a side loses bytes."""
        full = [" " + t if t else "" for t in texts]
        for text, a, b in zip(full, self.a(full), self.b([t or "" for t in texts]), strict=True):
            want = text.encode("utf-8", "surrogatepass")
            whole = want and all(
                b"".join(map(t.bytes.__getitem__, ids)) == want for t, ids in ((self.a, a), (self.b, b))
            )
            yield (a, b) if whole else ([], [])

    def align(self, ids_a: list[int], ids_b: list[int]) -> Aligned:
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        left, right, last_a, last_b = overlaps(np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b]))
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups before a token's
        first_b = np.flatnonzero(np.append(True, last_b[:-1]))  # where a group begins among the others
        after_a = np.flatnonzero(last_a) + 1
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + first_b[before_a]] = a + last_a * len(self.a.bytes)
        written[np.arange(len(b)) + after_a[before_b]] = b + last_b * self.n_b + 2 * len(self.a.bytes)
        text = b"".join(self.names[written].tolist())[:-1]
        pairs, counts = np.unique(a[left] * self.n_b + b[right], return_counts=True)
        return Aligned(int(last_a.sum()), len(left), text, pairs, counts)


def pair_kind(n_a: int, n_b: int) -> str:
    """How a pair ``a * n_b + b`` is stored."""
    return "<u4" if n_a * n_b < 1 << 32 else "<i8"


def _stored(pairs: np.ndarray, counts: np.ndarray, kind: str) -> tuple[bytes, bytes]:
    """Pairs and counts of one byte each; a pair with a larger count comes several times."""
    if len(counts) and counts.max() > 255:
        times = -(-counts // 255)
        last = np.cumsum(times) - 1
        rest = counts - (times - 1) * 255
        pairs, counts = np.repeat(pairs, times), np.full(int(times.sum()), 255)
        counts[last] = rest
    return pairs.astype(kind).tobytes(), counts.astype(np.uint8).tobytes()


_ALIGNED = pa.schema(
    [
        ("_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("groups", pa.string()),
        ("_pairs", pa.binary()),
        ("_counts", pa.binary()),
    ]
)
_DDL = (
    "_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "_pairs binary, _counts binary"
)


def _align_udf(path_a: str, path_b: str, keep: bool):
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(at, _TEXTS_AT_ONCE)
                aligner = aligner or Aligner(path_a, path_b)
                rows = []
                for a, b in aligner.texts(part.column(1).to_pylist()):
                    if not a:
                        rows.append((0, 0, 0, 0, "", "" if keep else None, b"", b""))
                        continue
                    x = aligner.align(a, b)
                    digest = hashlib.sha256(x.text).hexdigest()
                    groups = x.text.decode() if keep else None
                    stored = _stored(x.pairs, x.counts, aligner.kind)
                    rows.append((len(a), len(b), x.groups, x.links, digest, groups, *stored))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ALIGNED.types[1:], strict=True)]
                yield pa.record_batch([part.column(0), *columns], schema=_ALIGNED)

    return aligned


def _flat(batch: pa.RecordBatch, pairs: int, counts: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, pair and count of all entries of a batch."""
    found = batch.column(counts).to_pylist()
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    keys = np.frombuffer(b"".join(batch.column(pairs).to_pylist()), kind).astype(np.int64)
    values = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)
    return np.repeat(np.arange(len(found)), sizes), keys, values


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, values, len(names)).astype(np.int64)


def pair_counts(stored: DataFrame, n_b: int, kind: str, held: int = _HELD) -> DataFrame:
    """``(pair, n, best)``: how often each pair is linked, and whether no partner of its B id is above."""
    schema = pa.schema([("pair", pa.int64()), ("k", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, k, v = _flat(batch, 0, 1, kind)
            keys, values = _summed(np.concatenate([keys, k]), np.concatenate([values, v]))
            if len(keys) > held:
                yield pa.record_batch([keys, values], schema=schema)
                keys, values = keys[:0], values[:0]
        yield pa.record_batch([keys, values], schema=schema)

    entries = stored.select("_pairs", "_counts").mapInArrow(partial, "pair long, k long")
    counted = checkpointed(entries.groupBy("pair").agg(F.sum("k").alias("n")))
    b = F.pmod("pair", F.lit(n_b)).alias("b")
    most = counted.groupBy(b).agg(F.max("n").alias("most"))
    # one row for each id of the second vocabulary at most
    known = counted.withColumn("b", b).join(F.broadcast(most), "b")
    return known.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(stored: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray], kind: str) -> DataFrame:
    """``(_row, known_best, known_sum, rest)``: sums over the pairs of the table, and all other pairs."""
    table = stored.sparkSession.sparkContext.broadcast(table)
    entry = pa.list_(pa.struct([("pair", pa.int64()), ("k", pa.int64())]))
    schema = pa.schema([("_row", pa.int64()), ("known_best", pa.int64()), ("known_sum", pa.int64()), ("rest", entry)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, best = table.value
        for batch in batches:
            row, pair, k = _flat(batch, 1, 2, kind)
            at = np.minimum(np.searchsorted(names, pair), len(names) - 1)
            known = names[at] == pair
            size = batch.num_rows
            sums = np.zeros((2, size), np.int64)
            np.add.at(sums[0], row[known], (k * best[at])[known])
            np.add.at(sums[1], row[known], (k * n[at])[known])
            offsets = np.append(0, np.cumsum(np.bincount(row[~known], minlength=size))).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(pair[~known]), pa.array(k[~known])], ["pair", "k"])
            lists = pa.ListArray.from_arrays(pa.array(offsets), rest)
            yield pa.record_batch([batch.column(0), *map(pa.array, sums), lists.cast(entry)], schema=schema)

    return stored.select("_row", "_pairs", "_counts").mapInArrow(
        look, "_row long, known_best long, known_sum long, rest array<struct<pair:long,k:long>>"
    )


def aligned(
    docs: DataFrame,
    tokenizer_a: str,
    model_b: str,
    id_column: str = "doc_id",
    text: str = "text",
    keep_groups: bool = False,
    frequent: int = FREQUENT,
) -> DataFrame:
    """The alignment of every row's text, one row each.

    ``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, and ``groups`` on
    request: ``a1,a2|b1;a3|b2,b3``, the ids of either side by group. Side A is the byte-level
    tokenizer on a space and the text, side B the sentence-piece model on the text (it adds the
    space). A link is a token of A and one of B with overlapping bytes; ``count_sum`` adds up how
    often each link's id pair is linked in all rows, ``n_best`` counts the links whose pair is the
    most frequent of its B id, ties included.

    Null and empty texts, and texts that one side doesn't give back byte by byte, have no tokens:
    zeros and an empty digest. A very long text is one entry of its task; its pairs are counted there.
    Repeated rows count as often as they occur and each come back; rows without an id take part. An
    empty table gives no rows. Only the two columns named are read, so others may have any name.
    """
    probe = Aligner(tokenizer_a, model_b)
    n_b, kind = probe.n_b, probe.kind
    found = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(
        _align_udf(tokenizer_a, model_b, keep_groups), _DDL
    )
    stored = checkpointed(found.withColumn("_row", F.monotonically_increasing_id()))
    pairs = checkpointed(pair_counts(stored, n_b, kind))
    top = pairs.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    # no pair is -1: it keeps the table from being empty
    table = tuple(np.append(e, top[c].to_numpy(np.int64)) for c, e in (("pair", -1), ("n", 0), ("best", 0)))
    looked = _looked_up(stored, table, kind)
    others: Column = F.explode("rest")
    rest = (
        looked.select("_row", others.alias("e"))
        .select("_row", F.col("e.pair").alias("pair"), F.col("e.k").alias("k"))
        .join(pairs, "pair")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("rest_best"),
            F.sum(F.col("k") * F.col("n")).alias("rest_sum"),
        )
    )
    known = looked.select("_row", "known_best", "known_sum")
    rows = stored.drop("_pairs", "_counts").join(known, "_row").join(rest, "_row", "left")
    out = rows.select(
        F.col("_id").alias("id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("known_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("known_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
        "groups",
    )
    return out if keep_groups else out.drop("groups")
