"""Reload of late months as a stream over landed purchase files.

The newest months are published incomplete and again later. Each landed file replaces the file of
the same name: a micro-batch overwrites only the (``competencia``, ``arquivo``) partitions it carries,
so a month may come in several files, and replaying a batch after a failure gives the same table. A
file that carries no rows replaces nothing. Versions of one contract across months are resolved when the
contracts table is built (``plans.contracts.latest_versions``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contraluz.functions.charset import repair_latin_text
from contraluz.plans.contracts import from_purchases
from contraluz.schemas import strings
from contraluz.sources.delimited import DIALECT, with_period
from contraluz.sources.landing import refresh_months


def read_purchase_stream(spark: SparkSession, folder: str, header: Sequence[str]) -> DataFrame:
    """Purchase files as they land, one file per micro-batch, oldest first."""
    raw = (
        spark.readStream.schema(strings(list(header)))
        .options(header=True, multiLine=True, encoding="ISO-8859-1", mode="FAILFAST", **DIALECT)
        .options(columnPruning=False, enforceSchema=False)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", "1")
        .csv(folder)
    )
    path = F.col("_metadata.file_path")
    fields = [repair_latin_text(F.col(f"`{name}`")).alias(name) for name in header]
    name = F.element_at(F.split(path, "/"), -1).alias("arquivo")
    return with_period(raw.select(*fields, path.alias("_arquivo"), name))


def refresh_on_landing(
    spark: SparkSession, folder: str, header: Sequence[str], table: str, checkpoint: str
) -> StreamingQuery:
    """Take in every file landed since the last run, then stop."""

    def replace_months(batch: DataFrame, _: int) -> None:
        refresh_months(batch, table, ["competencia", "arquivo"])

    published = from_purchases(read_purchase_stream(spark, folder, header), keep=["arquivo"])
    return (
        published.writeStream.foreachBatch(replace_months)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
