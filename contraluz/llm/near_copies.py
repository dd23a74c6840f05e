"""Near copies by the exact Jaccard similarity of their word shingles (pipeline, with operator 3).

Two texts are near copies if the sets of their five-word shingles have a similarity of 0.8 or more.
All such pairs are found by prefix filtering: with shingles in one order for all texts, rarest first,
two sets of that similarity share one of the first ``n - ceil(0.8 n) + 1`` shingles of each. Shingles
of one text only are counted in that prefix but match nothing, so a text with over a fifth of its own
is done. For that order a shingle is the first 40 bits of its hash: shingles that share them are
counted as one, which may add candidates but loses none.

Texts that share a prefix shingle are a cell. Sizes, places in the order and the parities of 512 bit
sketches rule out pairs that cannot be similar; what remains links texts into blocks, and a cell hands
on a forest of it, never its pairs. A block gets the set of each member once, computed again from the
text, and intersects what is not linked yet: its result is a forest as well. A block of very many
shingles is cut into parts, each pair of which is compared. A text is known by the 64-bit hash of its
set, so copies are one row (a task hands on each set once).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.common import checkpointed, shuffle_partitions
from contraluz.llm.components import connected_components
from contraluz.llm.simhash import _merge

SEED = 42
WIDTH = 5
# similarity of 4/5: in whole numbers, so that pairs at the limit are decided exactly
PART, WHOLE = 4, 5
_PAIRS_AT_ONCE = 1 << 18
_BROADCAST = 1 << 20  # counted ids up to which they are sent to the texts, not the texts shuffled
_TEXTS_AT_ONCE = 64  # whose sets a task holds before it hands them on
_DEALT_AT_ONCE = 1 << 18  # shingles that a task deals out together
_PART_SHINGLES = 1 << 20  # shingles that are counted together
_BLOCK_SHINGLES = 1 << 20  # shingles of a block, or of a part of it, that are compared together
_BITS, _BYTES = 40, 5  # of a shingle's hash, while shingles are counted
_MOST = (1 << 23) - 1  # counts are told apart up to here
_SKETCH = [f"s{i}" for i in range(8)]
_NAMED = ["node", "n", "m", *_SKETCH]
_NAME = T.StructType([T.StructField(name, T.LongType()) for name in _NAMED])
_SET = T.StructType().add("node", T.LongType()).add("shingles", T.ArrayType(T.LongType()))
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_DEALT = pa.schema([("part", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a shorter text is one shingle of all its words.

    Words are those of ``simhash.fingerprint_text``. A text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(width, len(words))
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def _name(shingles: np.ndarray) -> int:
    """Hash of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def _tokens_of(shingles: np.ndarray) -> np.ndarray:
    """The distinct first bits of a set's hashes; sorted hashes with equal ones are neighbours."""
    tokens = shingles.view(np.uint64) >> np.uint64(64 - _BITS)
    return tokens[np.append(True, tokens[1:] != tokens[:-1])] if len(tokens) else tokens


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """512 parities: two sets' sketches differ in no more bits than the sets have different shingles."""
    odd = np.bincount(shingles & 511, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@F.arrow_udf(_NAME)
def _names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hash, size, tokens and sketch of each text's set; one set is held at a time."""
    for texts in batches:
        found = np.zeros((len(_NAMED), len(texts)), np.int64)
        for i, text in enumerate(texts):
            shingles = shingle_set(text.as_py())
            found[:3, i] = _name(shingles), len(shingles), len(_tokens_of(shingles))
            found[3:, i] = _sketch(shingles)
        yield pa.StructArray.from_arrays([pa.array(row) for row in found], _NAMED)


@F.arrow_udf(_SET)
def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's set with its hash, handed on for a few texts at a time."""
    for texts in batches:
        for at in range(0, len(texts), _TEXTS_AT_ONCE):
            found = [shingle_set(text.as_py()) for text in texts.slice(at, _TEXTS_AT_ONCE)]
            nodes = pa.array([_name(s) for s in found], pa.int64())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.StructArray.from_arrays([nodes, shingles], ["node", "shingles"])


# else the null check of a join on ``node`` is pushed below, and a second worker makes each set again
_sets = _sets.asNondeterministic()


def _column(column: pa.Array) -> np.ndarray:
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False)
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    rows = np.empty(len(column), object)
    rows[:] = [values[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return rows


def _cells(
    batches: Iterator[pa.RecordBatch],
    work: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]],
    keys: int = 1,
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first columns in; ``work`` gets whole cells of these, several at a time."""
    rest: list[list[np.ndarray]] = []

    def whole() -> list[np.ndarray]:
        return [np.concatenate(parts) for parts in zip(*rest, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_column(column) for column in batch.columns]
        if rest and any(rest[-1][k][-1] != columns[k][0] for k in range(keys)):
            yield from work(whole())
            rest = []
        other = np.logical_or.reduce([column != column[-1] for column in columns[:keys]])
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            rest.append([column[:cut] for column in columns])
            yield from work(whole())
            rest = []
        rest.append([column[cut:] for column in columns])
    if rest:
        yield from work(whole())


def _numbered(keys: list[np.ndarray]) -> np.ndarray:
    """Number of each row's cell, from 0."""
    change = np.zeros(len(keys[0]), bool)
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.cumsum(change)


def _pairs(cell: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within cells whose sizes allow the similarity, in parts; rows come by cell and size."""
    far = WHOLE * int(n.max()) + 1
    ends = np.searchsorted(cell * far + PART * n, cell * far + WHOLE * n, side="right")
    more = ends - np.arange(len(n)) - 1
    upto = np.append(0, np.cumsum(more))
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + _PAIRS_AT_ONCE, side="right")) - 1)
        rows, sizes = np.arange(at, stop), more[at:stop]
        if sizes.any():
            left = np.repeat(rows, sizes)
            yield left, np.arange(len(left)) - np.repeat(upto[at:stop] - upto[at], sizes) + left + 1
        at = stop


def _forest(known: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    hung = np.flatnonzero(label != np.arange(len(label)))
    return pa.record_batch([known[hung], known[label[hung]]], schema=_PAIRS)


def _alike(sketch: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the sketches leave it open that pairs are similar enough."""
    differ = np.bitwise_count((sketch[left] ^ sketch[right]).view(np.uint64)).sum(1, dtype=np.int64)
    return (PART + WHOLE) * differ <= n[left] + n[right]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the pairs of each cell that can be similar enough."""

    def work(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, n, row, at = columns[:4]
        sketch = np.stack(columns[4:], 1)
        known, code = np.unique(row, return_inverse=True)
        label = np.arange(len(known))
        for left, right in _pairs(_numbered([token]), n):
            keep = label[code[left]] != label[code[right]]
            left, right = left[keep], right[keep]
            # the most that two sets can share if this is the first shingle they share
            most = 1 + np.minimum(n[left] - at[left], n[right] - at[right])
            keep = (PART + WHOLE) * most >= PART * (n[left] + n[right])
            left, right = left[keep], right[keep]
            keep = _alike(sketch, n, left, right)
            if keep.any():
                label = _merge(label, code[left[keep]], code[right[keep]])
        yield _forest(known, label)

    return _cells(batches, work)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that span the similar pairs of each block, or of each pair of a block's parts."""

    def work(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, lo, hi, n, own, node, sets = columns
        sketch = np.stack([_sketch(shingles) for shingles in sets])
        known, code = np.unique(node, return_inverse=True)
        parent = list(range(len(known)))
        label = np.arange(len(known))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for left, right in _pairs(_numbered(columns[:3]), n):
            keep = (label[code[left]] != label[code[right]]) & ((lo[left] == hi[left]) | (own[left] != own[right]))
            left, right = left[keep], right[keep]
            keep = _alike(sketch, n, left, right)
            linked = False
            for i, k in zip(left[keep].tolist(), right[keep].tolist(), strict=True):
                a, b = find(code[i]), find(code[k])
                if a != b:
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if (PART + WHOLE) * both >= PART * (n[i] + n[k]):
                        parent[max(a, b)] = min(a, b)
                        linked = True
            if linked:
                label = np.array([find(x) for x in range(len(known))])
        yield _forest(known, label)

    return _cells(batches, work, 3)


def _dealt(texts: DataFrame, parts: int) -> DataFrame:
    """The tokens of every set dealt to parts, copies within a task once.

    A row has tokens of one part of several texts, and how many each of these has in it.
    """

    def rows(names: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(names)), [len(tokens) for tokens in lists])
        tokens = np.concatenate(lists)
        part = (tokens % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part, kind="stable")
        owner, tokens, part = owner[by], tokens[by], part[by]
        octets = tokens.view(np.uint8).reshape(-1, 8)[:, :_BYTES]
        first = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))
        sizes = np.diff(np.append(first, len(part))).astype(np.uint32)
        nodes = np.array(names, np.int64)[owner[first]]
        cuts = np.flatnonzero(np.append(True, part[first][1:] != part[first][:-1]))
        ends = np.append(cuts, len(first))
        at = np.append(first, len(part))[ends]
        spans = list(zip(cuts.tolist(), ends[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))
        return pa.record_batch(
            [
                pa.array(part[first[cuts]]),
                pa.array([nodes[s:e].tobytes() for s, e, _, _ in spans], pa.binary()),
                pa.array([sizes[s:e].tobytes() for s, e, _, _ in spans], pa.binary()),
                pa.array([octets[s:e].tobytes() for _, _, s, e in spans], pa.binary()),
            ],
            schema=_DEALT,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names: list[int] = []
        lists: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for text in batch.column(0):
                shingles = shingle_set(text.as_py())
                name = _name(shingles)
                if len(shingles) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    lists.append(_tokens_of(shingles))
                    held += len(lists[-1])
                if held >= _DEALT_AT_ONCE:
                    yield rows(names, lists)
                    names, lists, held = [], [], 0
        if held:
            yield rows(names, lists)

    return texts.select("text").mapInArrow(work, "part int, nodes binary, sizes binary, tokens binary")


def _counted(row: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
    """The rows and tokens whose token has several rows; copies from several tasks are one row."""
    by = np.lexsort((row, token))
    row, token = row[by], token[by]
    new = np.append(True, (row[1:] != row[:-1]) | (token[1:] != token[:-1]))[: len(row)]
    row, token = row[new], token[new]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    sizes = np.diff(np.append(starts, len(token)))
    df = np.repeat(sizes, sizes)
    keep = df > 1
    key = np.minimum(df[keep], _MOST) << _BITS | token[keep]
    return pa.record_batch([row[keep], key], ["row", "key"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's tokens that several texts have, with these, as ``count << 40 | token``."""
    rows, tokens = [np.zeros(0, np.int64)], [np.zeros((0, _BYTES), np.uint8)]
    for batch in batches:
        for nodes, sizes, octets in zip(*batch.columns[1:], strict=True):
            names = np.frombuffer(nodes.as_py(), np.int64)
            rows.append(np.repeat(names, np.frombuffer(sizes.as_py(), np.uint32)))
            tokens.append(np.frombuffer(octets.as_py(), np.uint8).reshape(-1, _BYTES))
    row, octets = np.concatenate(rows), np.concatenate(tokens)
    del rows, tokens
    for at in range(8):  # an eighth of the tokens at a time: sorting needs many times their bytes
        picked = octets[:, 1] >> 5 == at
        wide = np.zeros((int(picked.sum()), 8), np.uint8)
        wide[:, :_BYTES] = octets[picked]
        yield _counted(row[picked], wide.view(np.int64).ravel())


def _prefixes(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(token, n, row, at)`` and sketch: prefix shingles that others have, of texts that can have a partner."""
    total = nodes.agg(F.sum("m")).first()[0] or 0
    parts = max(shuffle_partitions(nodes.sparkSession), -(-total // _PART_SHINGLES))
    shared = _dealt(texts, parts).repartitionById(parts, "part").mapInArrow(_shared, "row long, key long")
    n, own = F.col("n"), F.col("m") - F.size("list")
    least = F.floor((PART * n + WHOLE - 1) / F.lit(WHOLE))
    taken = (n - least + 1 - own).cast("int")
    listed = (
        shared.groupBy("row")
        .agg(F.collect_list("key").alias("list"))
        .join(nodes.select(F.col("node").alias("row"), "n", "m", *_SKETCH), "row")
        .where(taken > 0)
    )
    first = F.slice(F.sort_array("list"), F.lit(1), taken)
    return listed.select("row", "n", own.alias("own"), *_SKETCH, F.posexplode(first).alias("k", "token")).select(
        "token", "n", "row", (F.col("own") + F.col("k") + 1).cast("long").alias("at"), *_SKETCH
    )


def _in_cells(df: DataFrame, keys: list[str], by: str = "n") -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, by)


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that span the similar pairs among rows that ``pairs`` connect; sets are computed again."""
    named = connected_components(pairs).select(F.col("a").alias("node"), F.col("component").alias("block"))
    members = named.unionAll(named.select(F.col("block").alias("node"), "block").distinct()).join(nodes.select("node", "id", "n"), "node")
    blocks = members.groupBy("block").agg(F.ceil(F.sum("n") / _BLOCK_SHINGLES).cast("int").alias("g"))
    members = checkpointed(members.join(blocks, "block"))
    ids = members.select("id").distinct()
    small = ids.limit(_BROADCAST + 1).count() <= _BROADCAST
    held = texts.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    sets = held.select(_sets(F.col("text")).alias("s")).select("s.*").dropDuplicates(["node"])
    dealt = (
        sets.join(members, "node")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        .select("block", "lo", "hi", "n", "own", "node", "shingles")
    )
    return _in_cells(dealt, ["block", "lo", "hi"]).mapInArrow(_links, "a long, b long")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, component)`` of every row with an id: texts of similarity 0.8 or more link.

    The component is the smallest id that can be reached. Texts with the same set of shingles link,
    those without words among them (null and empty texts are such). A very long text is one set in
    its task; a shingle that very many texts share is one cell. Repeated rows each come back; rows of
    one id with different texts are rows of their own. An empty table gives no rows. Only the two
    columns named are read, so others may have any name. ``docs`` is read several times: hand in a
    written table.
    """
    texts = docs.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")
    )
    found = checkpointed(texts.select("id", _names(F.col("text")).alias("s")).select("id", "s.*"))
    rest = [F.max(name).alias(name) for name in _NAMED[1:]]
    nodes = checkpointed(found.groupBy("node").agg(F.min("id").alias("id"), *rest))
    cells = _in_cells(_prefixes(texts, nodes), ["token"])
    pairs = checkpointed(cells.mapInArrow(_candidates, "a long, b long").distinct())
    whole = connected_components(_similar(pairs, nodes, texts))
    named = nodes.join(whole, nodes["node"] == whole["a"], "left").select(
        "node", "id", F.coalesce("component", "node").alias("group")
    )
    least = named.groupBy("group").agg(F.min("id").alias("component"))
    labels = named.select("node", "group").join(least, "group").select("node", "component")
    return found.select("id", "node").join(labels, "node").select("id", "component")


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the row with the smallest id.

    Rows without an id stay. Of rows that repeat the kept id, all stay: they are one document.
    """
    groups = near_copies(docs, id_column, text)
    gone = groups.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["_gone"], "left_anti")
