"""Helpers that several operators share."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and go on from there.

    Later jobs read the written rows, so a lost executor costs a re-read only. Only where the
    setting is absent (tests, local runs) is a temporary folder used.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="contraluz-"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="contraluz-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex[:12]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lowered and every other character as it is."""
    by_letter = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(by_letter)


def in_chunks(items: list, rows: int) -> Iterator[list]:
    """Slices of at most ``rows`` items, so that what is derived from them stays small."""
    for start in range(0, len(items), rows):
        yield items[start : start + rows]


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores in front until no column (case ignored) has that name."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted
