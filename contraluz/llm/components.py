"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraluz.llm.common import checkpointed

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: equal before and after a round means nothing moved."""
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")
    ).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, component)`` for every node that is not the smallest of its component.

    ``edges`` has long columns ``a`` and ``b`` in any direction; loops and repeated rows do no harm,
    rows with a null take no part. Large-star and small-star rounds in turn: every neighbour of a
    node is hung on the smallest one. The table never exceeds twice the edges, needs about log(n)
    rounds, and is written to the shared folder after each. Minima are combined before the shuffle;
    the joins on hot nodes are inner equi-joins that adaptive execution splits.
    """
    start = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = checkpointed(start.distinct())
    state = _state(current)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
            .distinct()
        )
        large = checkpointed(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = (
            hung.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        current = checkpointed(small)
        after = _state(current)
        if after == state:
            return current.select("a", F.col("b").alias("component"))
        state = after
    if state[0]:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select("a", F.col("b").alias("component"))
