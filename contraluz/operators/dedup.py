"""Keep one row per key, decided by a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_top(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows: int | None = 1
) -> DataFrame:
    """First ``rows`` rows of every key; all of them if ``rows`` is None.

    Spark plans this as a group limit before and after the shuffle, so a key with very many
    copies sends at most ``rows`` rows per map task.
    """
    if rows is None:
        return df
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= rows)
        .drop("_rank")
    )


def remaining_order(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """Ascending order over the columns not in ``used``, so that ties cannot be arbitrary."""
    return [F.col(c).asc_nulls_last() for c in df.columns if c not in used]
