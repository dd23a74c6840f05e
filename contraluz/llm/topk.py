"""Exact top-k inner products by three-phase uniform thresholds (operator 9).

A score is the sum of the partial scores of ``SLICES`` slices of the dimensions. Phase 1: every task
lists the best candidates of each slice, and their whole scores; the k-th best score of all lists is
a floor the answer can't fall below. Phase 2: the floor is broadcast; a candidate at or above it must
reach floor / slices in some slice, so only entries that do are collected, and those whose missing
slices can't lift them to the floor are dropped. Phase 3: the scores of what remains are resolved
exactly. Ties at the floor stay, so the order by score and id is exact.

Partial scores are doubles with a proven bound on their error, which is allowed for wherever one is
compared; whole scores are integers, of any length where components are that large.

Queries are taken in blocks of bounded size; each block is broadcast and meets all candidates in two
passes over them. Equal vectors are one candidate with its smallest ids, which is all that can win. The
rows of a query's own id are left out before anything is listed: a candidate with no other id is masked.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contraluz.llm.common import checkpointed, shared_folder

K = 5
SCALE = 256
SLICES = 2
BLOCK = 2048
ROWS = 1024
_NONE = np.iinfo(np.int64).min  # no own id, and no only id
_DIGITS = 10**38 - 1


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: ``floor(256 * x)`` of each component, whole numbers as doubles, which is exact.

    Rows without id, null vectors and vectors with a null or non-finite component are left out, also
    where 256 times a component is beyond a double.
    """
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    # floor() gives a long, so what a long can't hold, and has no fraction anyway, is taken as it is
    whole = F.transform(
        "v", lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), scaled.alias("v"))
    return rows.where(kept).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, as missing components add nothing."""
    out = np.zeros((len(column), width), kind)
    ends = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), ends)
    places = np.arange(len(values)) - np.repeat(np.cumsum(ends) - ends, ends)
    keep = places < width
    out[rows[keep], places[keep]] = values[keep]
    return out


class QueryBlock:
    """Query vectors, and what a task does with them.

    ``own`` is the id whose rows a query leaves out, if these are several; ``safe`` says that no score
    is beyond a 64-bit integer.
    """

    def __init__(
        self, keys: list[int], vectors: list[list[float]], own: list[int | None], safe: bool
    ) -> None:
        self.keys = np.array(keys, np.int64)
        self.own = np.array([_NONE if o is None else o for o in own], np.int64)
        self.width, self.safe = max(map(len, vectors)), safe
        self.matrix = np.zeros((len(keys), self.width))
        for i, v in enumerate(vectors):
            self.matrix[i, : len(v)] = v
        self.lengths = np.sqrt((self.matrix**2).sum(1))
        cuts = np.linspace(0, self.width, SLICES + 1).astype(int)
        self.slices = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @property
    def kind(self) -> str:
        return f"q long, c long, score {'long' if self.safe else 'decimal(38,0)'}"

    def _rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Key, matrix and barred queries of some candidates at a time."""
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                only = part.column(2).fill_null(_NONE).to_numpy()
                barred = (only[:, None] == self.own[None, :]) & (self.own != _NONE)[None, :]
                yield part.column(0).to_numpy(), _matrix(part.column(1), self.width, np.float64), barred

    def _scores(self, x: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Exact scores: 64-bit integers, or Python's where these don't suffice."""
        out = np.empty(len(rows), np.int64 if self.safe else object)
        for at in range(0, len(rows), 1 << 14):
            part = slice(at, at + (1 << 14))
            if self.safe:
                a, b = x[rows[part]].astype(np.int64), self.matrix[queries[part]].astype(np.int64)
                out[part] = np.einsum("ij,ij->i", a, b)
            else:
                pairs = zip(x[rows[part]].tolist(), self.matrix[queries[part]].tolist(), strict=True)
                whole = (sum(int(a) * int(b) for a, b in zip(*pair, strict=True)) for pair in pairs)
                out[part] = [max(-_DIGITS, min(_DIGITS, score)) for score in whole]
        return out

    def _listed(self, queries: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        if self.safe:
            scores = pa.array(scores.astype(np.int64))
        else:
            scores = pa.array([Decimal(s) for s in scores.tolist()], pa.decimal128(38, 0))
        return pa.record_batch([self.keys[queries], keys, scores], ["q", "c", "score"])

    def local_lists(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Phase 1: of each query, the ``k`` best of what leads this task's slices."""
        n, least = len(self.keys), _NONE if self.safe else -_DIGITS - 1
        best = np.full((k, n), least, np.int64 if self.safe else object)
        ids = np.full((k, n), -1, np.int64)
        columns = np.arange(n)
        for keys, x, barred in self._rows(batches):
            top = min(k, len(x))
            lead = []
            for s in self.slices:
                part = x[:, s] @ self.matrix[:, s].T
                part[barred] = -np.inf
                lead.append(np.argpartition(-part, top - 1, axis=0)[:top])
            rows = np.sort(np.concatenate(lead), axis=0)
            good = ~barred[rows, columns]
            good[1:] &= rows[1:] != rows[:-1]  # a row that leads several slices counts once
            scores = np.full(rows.shape, least, best.dtype)
            at, query = np.nonzero(good)
            scores[at, query] = self._scores(x, rows[at, query], query)
            best, ids = np.concatenate([best, scores]), np.concatenate([ids, keys[rows]])
            order = np.argsort(best, axis=0, kind="stable")[::-1][:k]
            best, ids = best[order, columns], ids[order, columns]
        held, query = np.nonzero(best > least)
        yield self._listed(query, ids[held, query], best[held, query])

    def sufficient(
        self, batches: Iterator[pa.RecordBatch], floor: np.ndarray
    ) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: the exact scores of all candidates that reach the floor of a query.

        ``floor`` holds exact scores, or None where a query has too few candidates for one.
        """
        m, bits = len(self.slices), 2.0**-52
        near = np.array([-np.inf if f is None else float(f) for f in floor])
        exact = np.array([-_DIGITS - 1 if f is None else f for f in floor], object)
        near = near - np.where(np.isfinite(near), np.abs(near) * bits, 0)
        share = near / m
        for keys, x, barred in self._rows(batches):
            # a product of doubles is off by less than this, whatever the order of its sum
            slack = (self.width + 8) * bits * np.sqrt((x**2).sum(1))[:, None] * self.lengths[None, :]
            known, reported = np.zeros(slack.shape), np.zeros(slack.shape, np.int8)
            for s in self.slices:
                part = x[:, s] @ self.matrix[:, s].T + slack
                enough = ~(part < share)
                known += np.where(enough, part, 0)
                reported += enough
            rows, queries = np.nonzero((reported > 0) & ~barred)
            # a slice that wasn't reported is below its share of the floor
            missing = m - reported[rows, queries]
            most = known[rows, queries] + np.where(missing > 0, missing * share[queries], 0)
            most += slack[rows, queries] + np.abs(most) * 8 * bits
            keep = ~(most < near[queries])
            rows, queries = rows[keep], queries[keep]
            scores = self._scores(x, rows, queries)
            keep = np.array(scores >= exact[queries], bool)
            yield self._listed(queries[keep], keys[rows[keep]], scores[keep])


def _best(scores: DataFrame, k: int, by: str, then: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(then))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_scores(candidates: DataFrame, block: QueryBlock, k: int) -> DataFrame:
    """``(q, c, score)`` of at least the ``k`` best candidates of each query of the block."""
    vectors = candidates.select("c", "v", "only")
    lists = vectors.mapInArrow(lambda batches: block.local_lists(batches, k), block.kind)
    floor = np.full(len(block.keys), None, object)
    place = {key: i for i, key in enumerate(block.keys.tolist())}
    for row in _best(lists, k, "q", "c").where(F.col("rank") == k).select("q", "score").collect():
        floor[place[row["q"]]] = int(row["score"])
    return vectors.mapInArrow(lambda batches: block.sufficient(batches, floor), block.kind)


def top_k(
    vectors: DataFrame,
    is_query: F.Column,
    k: int = K,
    id_column: str = "vec_id",
    vector: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of each query, all if fewer.

    Queries are the rows for which ``is_query`` (over ``vec_id``) holds; candidates are all rows with
    another id. Equal scores rank by smaller id. Repeated rows (same id and vector) are one; rows of
    one id with different vectors are separate candidates and separate queries, each with its own
    ranking, and none is a candidate of another. A query without candidates gives no rows, like an
    empty table. Components that a vector lacks count as 0. Scores rank as exact integers of up to 38
    digits; those beyond count as equal. The column ``score`` stops at the bounds of a long.
    """
    rows = checkpointed(
        integer_vectors(vectors, id_column, vector).groupBy("v", "vec_id").agg(F.lit(1).alias("_one"))
    ).drop("_one")
    order = Window.partitionBy("v").orderBy("vec_id")
    candidates = checkpointed(
        rows.withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= k + 1)  # of equal vectors only the smallest ids can be in an answer
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("only", F.when(F.size("ids") == 1, F.col("ids")[0]))
        .withColumn("c", F.monotonically_increasing_id())
    )
    # an id of one vector meets itself in one row, which k + 1 places allow for; an id of several
    # is a query of its own for each of them
    several = rows.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").select("vec_id")
    own = several.withColumn("own", F.col("vec_id"))
    asked = checkpointed(rows.where(is_query).join(own, "vec_id", "left"))
    leaders = checkpointed(
        asked.groupBy("v", "own").agg(F.min("vec_id").alias("_id")).withColumn(
            "q", F.monotonically_increasing_id()
        )
    )
    sizes = rows.agg(
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"),
        F.max(F.size("v")).alias("width"),
    ).first()
    safe = (sizes["most"] or 0) ** 2 * max(sizes["width"] or 0, 1) < 2.0**62
    blocks = -(-leaders.count() // block)
    found, folder = None, f"{shared_folder(rows.sparkSession)}/top-k"
    for b in range(blocks):
        part = leaders.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "v", "own").collect()
        if not part:
            continue
        queries = QueryBlock([r["q"] for r in part], [r["v"] for r in part], [r["own"] for r in part], safe)
        found = _block_scores(candidates, queries, k + 1)
        if blocks > 1:  # all blocks in one table, read once
            found.write.mode("append").parquet(folder)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "q long, c long, score long")
    elif blocks > 1:
        found = rows.sparkSession.read.schema(found.schema).parquet(folder)
    listed = found.join(candidates.select("c", F.explode("ids").alias("vec_id")), "c")
    other = listed.join(leaders.select("q", "own"), "q").where("own is null or own <> vec_id")
    short = _best(other, k + 1, "q", "vec_id").select("q", "vec_id", "score")
    known = leaders.select("q", F.col("v").alias("_v"), F.col("own").alias("_own"))
    same = (F.col("v") == F.col("_v")) & F.col("own").eqNullSafe(F.col("_own"))
    named = asked.join(known, same).select(F.col("vec_id").alias("query_id"), "q")
    # rows of one id with different vectors are queries of their own, so they share no ranking
    answers = named.join(short, "q").where("query_id <> vec_id")
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.asc("vec_id"))
    bound = [F.lit(b).cast("decimal(38,0)") for b in (-(1 << 63), (1 << 63) - 1)]
    score = F.col("score") if safe else F.greatest(bound[0], F.least(bound[1], F.col("score"))).cast("long")
    return (
        answers.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", score.alias("score"))
    )
