"""Shards along a Hilbert curve through the metadata (operator 8).

Several metadata columns are quantised into cells of equal population, the cells' places on a
Hilbert curve order the rows, and runs of that order become shards. Rows that are close in all
dimensions lie close on the curve, so each shard spans a small box and a query with conditions on
any of the dimensions can skip most shards by their minima and maxima.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.common import checkpointed, free_name, shuffle_partitions, text_or_empty
from contraluz.llm.ranking import global_rank

SHARDS = 40
DIMENSIONS = ("source", "lang", "n_chars")
BITS = 5


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cell numbers below ``2 ** bits``.

    Skilling's transformation ("Programming the Hilbert curve", 2004) on whole columns; adjacent
    places are cells that differ by one in one dimension.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[:, i] & q) > 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[:, i] >> bit) & 1)
    return place


def _string_bounds(df: DataFrame, name: str, bits: int) -> list[str]:
    """Up to ``2 ** bits - 1`` values that cut the rows into equal parts, whole strings in byte order.

    Distinct values are counted, sorted by ranges and numbered by running totals: within a partition,
    then by one total for each partition.
    """
    spark = df.sparkSession
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(shuffle_partitions(spark), "value")
    placed = checkpointed(ranged.withColumn("part", F.spark_partition_id()))
    totals = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total, starts, before = sum(totals.values()), [], 0
    for part in sorted(totals):
        starts.append((part, before))
        before += totals[part]
    if not total:
        return []
    running = Window.partitionBy("part").orderBy("value")
    upto = F.sum("n").over(running) + F.col("start")
    cut = [F.floor(x * (1 << bits) / F.lit(total)) for x in (F.col("upto") - F.col("n"), F.col("upto"))]
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))  # one row a partition
    bounds = placed.join(offsets, "part").withColumn("upto", upto).where((cut[0] < cut[1]) & (F.col("upto") < total))
    return sorted((r["value"] for r in bounds.select("value").collect()), key=lambda v: v.encode())


def quantised(df: DataFrame, dims: Sequence[str], bits: int) -> DataFrame:
    """``df`` with an array column ``_cells``: per dimension how many quantile bounds a value exceeds.

    The bounds are quantiles over all rows, ``2 ** bits - 1`` of them a dimension at most; those of
    numbers are approximate. Null is in cell 0. Whatever the bounds, any cells give a valid order.
    """
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in texts]
    steps = {d: _string_bounds(df, d, bits) for d in texts}
    if numbers:
        row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 1000).alias(d) for d in numbers]).first()
        steps |= {d: sorted(set(row[d] or [])) for d in numbers}

    def exceeded(d: str) -> Column:
        value = F.col(d) if d in texts else F.col(d).cast("double")
        return F.size(F.filter(F.lit(steps[d]), lambda bound: value > bound)) if steps[d] else F.lit(0)

    return df.withColumn("_cells", F.array(*[exceeded(d) for d in dims]))


def curve_column(cells: str, bits: int) -> Column:
    @F.pandas_udf(T.LongType())
    def place(batch: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack(batch.to_numpy()), bits) if len(batch) else [], dtype="int64")

    return place(F.col(cells))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    dims: Sequence[str] = DIMENSIONS,
    bits: int = BITS,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Id, dimensions, ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot`` of every row.

    Law ``rows``: the shards' row counts differ by one at most. Ties on the curve are ordered by a
    hash of the text, so that equal texts lie together, and by id; rows equal in all of these are
    interchangeable. Null texts have 0 bytes, null dimensions lie in the lowest cell, rows without
    id take part. Fewer rows than shards leave shards empty; an empty table gives no rows. Texts are
    read once; what is shuffled is a narrow row for each document.
    """
    body = text_or_empty(text)
    narrow = docs.select(
        F.col(id_column).alias("id"),
        *[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)],
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("_tie"),
    )
    narrow = checkpointed(narrow)
    names = [f"d{i}" for i in range(len(dims))]
    keyed = quantised(narrow, names, bits).withColumn("curve", curve_column("_cells", bits))
    keyed = checkpointed(keyed.drop("_cells"))
    ranked, total = global_rank(keyed, ["curve", "_tie", "id"], name="_rank")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        ranked.withColumn("shard", F.expr(f"(_rank * {shards}L) div {max(total, 1)}L").cast("int"))
        .withColumn("slot", F.col("_rank") - first)
        .drop("_rank", "_tie")
        .withColumnsRenamed({f"d{i}": _output_name(d) for i, d in enumerate(dims)})
    )


def _output_name(dimension: str) -> str:
    return free_name(dimension, ["id", "size", "text_crc32", "curve", "shard", "slot"])


def manifest(sharded: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows, bytes and the box of each shard: what a reader needs to skip it."""
    names = [_output_name(d) for d in dims]
    return sharded.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        F.sum("size").alias("bytes"),
        *[F.min(d).alias(f"min_{d}") for d in names],
        *[F.max(d).alias(f"max_{d}") for d in names],
        *[F.count_if(F.col(d).isNull()).alias(f"nulls_{d}") for d in names],
    )


def shards_to_read(boxes: DataFrame, dimension: str, low, high) -> DataFrame:
    """Shards that may hold rows with ``low <= dimension <= high``."""
    return boxes.where((F.col(f"max_{dimension}") >= F.lit(low)) & (F.col(f"min_{dimension}") <= F.lit(high)))


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Write whole documents in curve order, one folder a shard. Ids must be unique and not null."""
    placed = sharded.select(F.col("id").alias("_id"), "shard", "slot", F.col("curve").alias("_curve"))
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    joined = docs.select(*keep).join(placed, docs[id_column] == placed["_id"]).drop("_id")
    (
        joined.repartitionByRange(F.col("shard"), F.col("slot"))
        .sortWithinPartitions("shard", "slot")
        .drop("_curve")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
