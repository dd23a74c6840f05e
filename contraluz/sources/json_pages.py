"""Landed pages of the contract and procurement interfaces."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contraluz.schemas import CONTRACT_RECORD, MODALITIES, PROCUREMENT_RECORD, page_of


def read_pages(
    spark: SparkSession,
    path: str | Sequence[str],
    record: StructType,
    multiline: bool = False,
    base: str | None = None,
) -> DataFrame:
    """Records of all pages below ``competencia=YYYYMM`` folders, with that month as a column.

    One page per line, or with ``multiline`` one page per file. A page holds at most 500 records.
    An empty body gives no rows. Paths of single files need their common folder as ``base``.
    """
    schema = page_of(record).add(StructField("competencia", StringType()))
    reader = spark.read.schema(schema).option("multiLine", str(multiline).lower())
    if base is not None:
        reader = reader.option("basePath", base)
    pages = reader.json(path if isinstance(path, str) else list(path))
    return pages.select(F.explode("data").alias("r"), "competencia").select("r.*", "competencia")


def read_contract_pages(
    spark: SparkSession, path: str | Sequence[str], multiline: bool = False, base: str | None = None
) -> DataFrame:
    return read_pages(spark, path, CONTRACT_RECORD, multiline, base)


def modality_lookup(spark: SparkSession) -> DataFrame:
    """The fixed procurement modalities (14 rows)."""
    return spark.createDataFrame(list(MODALITIES.items()), "modalidade_id int, modalidade string")


def check_modalities(codes: Iterable[int]) -> list[int]:
    codes = list(codes)
    unknown = sorted(set(codes) - set(MODALITIES))
    if unknown:
        raise ValueError(f"unknown modalities {unknown}")
    return codes


def read_procurement_pages(
    spark: SparkSession, path: str, codes: Iterable[int] | None = None, multiline: bool = False
) -> DataFrame:
    """Procurements with the name of their modality; only those of ``codes`` if given.

    Records of a modality without a name are kept, with a null name.
    """
    rows = read_pages(spark, path, PROCUREMENT_RECORD, multiline).select(
        F.col("numeroControlePNCP").alias("numero"),
        F.col("modalidadeId").alias("modalidade_id"),
        F.col("objetoCompra").alias("objeto"),
        "competencia",
    )
    if codes is not None:
        rows = rows.filter(F.col("modalidade_id").isin(check_modalities(codes)))
    # the lookup has at most 14 rows
    return rows.join(F.broadcast(modality_lookup(spark)), "modalidade_id", "left")
