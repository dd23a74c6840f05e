"""Global positions without a single-task window."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraluz.llm.common import checkpointed, shuffle_partitions


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """Number the rows of ``df`` from 0 in the order of ``order``; also the number of rows.

    Rows are range-partitioned and sorted, and written once with their place in their partition;
    adding the sizes of earlier partitions (one number each, all the driver sees) makes the places
    global. ``order`` should end in a nearly unique column: that is what lets a hot value be split.
    Nulls come first; rows equal in ``order`` get neighbouring numbers in any order. An empty input
    stays empty. ``df`` is read twice (sample, sort), so hand in a written table.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = checkpointed(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(
        (row["p"], row["n"])
        for row in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
    )
    starts, total = [], 0
    for _, n in sizes:
        starts.append(total)
        total += n
    # as an Arrow table: rows of Python go through Python workers of their own
    offsets = spark.createDataFrame(
        pa.table({"_p": pa.array([p for p, _ in sizes], pa.int64()), "_start": pa.array(starts, pa.int64())})
    )
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = (
        placed.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")  # one row a partition
        .withColumn(name, F.col("_start") + within)
        .drop("_p", "_start", "_at")
    )
    return ranked, total
