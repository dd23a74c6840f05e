"""Joins inside groups of very uneven size.

A group of n members has n*(n-1)/2 pairs. Where the pairs are the wanted result, a big group must
not land in one task: its members are spread over blocks, and every pair of blocks becomes a join
cell of its own. Small groups have one block, so for them this is a plain equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Members of one side in one join cell, so that a cell gives about a million pairs at most.
CELL_ROWS = 1_000
# Hot keys up to this number are broadcast; more of them are joined by a salted shuffle.
BROADCAST_KEYS = 50_000
# Tasks over which the rows of a hot key are spread in that shuffle. The hot key table is copied
# this many times; it has at most rows / CELL_ROWS keys, so the copies stay below
# SALTS / CELL_ROWS of the input.
SALTS = 256


def _range(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than fit one cell, with their block counts, and whether they are few."""

    table: DataFrame
    few: bool


def _find_hot(sizes: DataFrame, broadcast_keys: int) -> HotKeys | None:
    """Count now (one job) which keys are hot. Usually none is and a plain join will do."""
    rows = sizes.limit(broadcast_keys + 1).collect()
    if not rows:
        return None
    if len(rows) <= broadcast_keys:
        return HotKeys(sizes.sparkSession.createDataFrame(rows, sizes.schema), True)
    return HotKeys(sizes, False)


def _attach_blocks(
    df: DataFrame, keys: Sequence[str], member: str, hot: HotKeys, columns: Sequence[str]
) -> DataFrame:
    """Give every row the block counts of its key; cold keys get one block."""
    table = hot.table.select(*keys, *columns)
    if hot.few:
        joined = df.join(F.broadcast(table), [*keys], "left")
    else:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(member), _long(SALTS)))
        copies = table.withColumn("_salt", _range(_long(0), _long(SALTS - 1)))
        joined = salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
    for column in columns:
        joined = joined.withColumn(column, F.coalesce(column, _long(1)))
    return joined


def _blocks(rows: Column, cell_rows: int) -> Column:
    return F.ceil(rows / F.lit(cell_rows)).cast("long")


def _block_of(member: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(member)), F.col(blocks))


def pairs_within(
    df: DataFrame,
    keys: Sequence[str],
    member: str,
    cell_rows: int = CELL_ROWS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Every unordered pair of distinct members sharing ``keys``: keys, ``a`` < ``b``.

    ``df`` holds each (keys, member) once and is read several times: pass a written table.
    """
    rows = df.select(*keys, member)
    sizes = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > cell_rows)
        .select(*keys, _blocks(F.col("_n"), cell_rows).alias("_nb"))
    )
    hot = _find_hot(sizes, broadcast_keys)
    if hot is None:
        left = rows.withColumnRenamed(member, "a")
        return left.join(rows.withColumnRenamed(member, "b"), [*keys]).filter("a < b")
    tagged = _attach_blocks(rows, keys, member, hot, ["_nb"]).withColumn(
        "_blk", _block_of(member, "_nb")
    )
    left = tagged.select(
        *keys,
        F.col(member).alias("_l"),
        F.col("_blk").alias("_i"),
        _range(F.col("_blk"), F.col("_nb") - 1).alias("_j"),
    )
    right = tagged.select(
        *keys,
        F.col(member).alias("_r"),
        _range(_long(0), F.col("_blk")).alias("_i"),
        F.col("_blk").alias("_j"),
    )
    ordered = (F.col("_i") < F.col("_j")) | (F.col("_l") < F.col("_r"))
    return (
        left.join(right, [*keys, "_i", "_j"])
        .filter(ordered)
        .select(
            *keys,
            F.least("_l", "_r").alias("a"),
            F.greatest("_l", "_r").alias("b"),
        )
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_member: str,
    right_member: str,
    cell_rows: int = CELL_ROWS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Inner equi-join in which keys that are hot on either side are cut into a grid of cells.

    ``left_member`` and ``right_member`` are the columns whose hash spreads the rows of one key.
    Both inputs are read several times.
    """
    one, none = _long(1), _long(0)
    both = left.select(*keys, one.alias("_l"), none.alias("_r")).union(
        right.select(*keys, none.alias("_l"), one.alias("_r"))
    )
    sizes = (
        both.groupBy(*keys)
        .agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
        .filter((F.col("_nl") > 0) & (F.col("_nr") > 0))
        .filter((F.col("_nl") > cell_rows) | (F.col("_nr") > cell_rows))
        .select(
            *keys,
            _blocks(F.col("_nl"), cell_rows).alias("_bl"),
            _blocks(F.col("_nr"), cell_rows).alias("_br"),
        )
    )
    hot = _find_hot(sizes, broadcast_keys)
    if hot is None:
        return left.join(right, [*keys])
    lefts = (
        _attach_blocks(left, keys, left_member, hot, ["_bl", "_br"])
        .withColumn("_i", _block_of(left_member, "_bl"))
        .withColumn("_j", _range(none, F.col("_br") - 1))
        .drop("_bl", "_br")
    )
    rights = (
        _attach_blocks(right, keys, right_member, hot, ["_bl", "_br"])
        .withColumn("_j", _block_of(right_member, "_br"))
        .withColumn("_i", _range(none, F.col("_bl") - 1))
        .drop("_bl", "_br")
    )
    return lefts.join(rights, [*keys, "_i", "_j"]).drop("_i", "_j")
