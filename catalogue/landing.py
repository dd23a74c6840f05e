"""Files written from the test tables, for the queries that read files."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogue.standin import LENIENCY_HEADER, PURCHASE_HEADER, Standin

CSV = {"sep": ";", "quote": '"', "escape": '"', "quoteAll": True, "encoding": "ISO-8859-1"}


def customer_csv(v: Standin) -> str:
    """The customer table with a header."""

    def write(folder: str) -> None:
        rows = v.table("customer")
        rows.select(*[F.col(c).cast("string") for c in rows.columns]).write.csv(
            folder, header=True, **CSV
        )

    return v.landed("customer_csv", write)


def documents_csv(v: Standin) -> str:
    """Ids and texts of the documents; a text is one quoted field with all its line breaks."""

    def write(folder: str) -> None:
        rows = v.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        rows.write.csv(folder, header=True, **{**CSV, "encoding": "UTF-8"})

    return v.landed("documentos_csv", write)


def establishments_csv(v: Standin) -> str:
    """The establishment register without a header."""
    return v.landed("estabelecimentos_csv", lambda f: v.raw_establishments().write.csv(f, **CSV))


def leniency_csv(v: Standin) -> str:
    """The leniency file whose header has the byte 0x96 (a Windows-1252 en dash) for hyphens."""

    def write(folder: str) -> None:
        names = [name.replace(" - ", " \u0096 ") for name in LENIENCY_HEADER]
        v.raw_leniency().toDF(*names).write.csv(folder, header=True, **CSV)

    return v.landed("leniencia_csv", write)


def _publish(purchases: DataFrame, folder: str) -> None:
    """Purchase files in month folders named like the published files; months that exist are replaced.

    Range partitioning keeps the number of files low and still splits a month that is very large.
    """
    (
        purchases.withColumn("arquivo", F.concat("competencia", F.lit("_Compras")))
        .drop("competencia")
        .repartitionByRange("arquivo", "Número do Contrato")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("arquivo")
        .csv(folder, header=True, **CSV)
    )


def purchases_csv(v: Standin) -> str:
    return v.landed("compras_csv", lambda folder: _publish(v.raw_purchases(), folder))


def publish_early(v: Standin, folder: str) -> list[str]:
    """All months, the newest two as they first come out: half the rows, other values."""
    raw = v.raw_purchases()
    months = raw.select("competencia").distinct().orderBy(F.desc("competencia")).limit(2)
    newest = [row["competencia"] for row in months.collect()]
    late = F.col("competencia").isin(newest)
    early = raw.filter(~late | (F.crc32("Número do Contrato") % 2 == 0)).withColumn(
        "Valor Final Compra", F.when(late, F.lit("1,00")).otherwise(F.col("Valor Final Compra"))
    )
    _publish(early, folder)
    return newest


def publish_again(v: Standin, folder: str, months: list[str]) -> None:
    """The given months as they are in the end."""
    _publish(v.raw_purchases().filter(F.col("competencia").isin(months)), folder)


def _quoted(name: str) -> Column:
    value = F.coalesce(F.col(f"`{name}`"), F.lit(""))
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def purchases_zip(v: Standin) -> list[str]:
    """Purchase archives, one per task, with a ``YYYYMM_Compras.csv`` member per month.

    Even months are ISO-8859-1 and odd months UTF-8, under one ISO-8859-1 header.
    """
    header = ";".join(f'"{name}"' for name in PURCHASE_HEADER).encode("iso-8859-1")

    def write(folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            path = f"{folder}/{part:05d}_compras.zip"
            month, member = None, None
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
                for batch in batches:
                    for period, line in zip(*(column.to_pylist() for column in batch.columns)):
                        if period != month:
                            if member:
                                member.close()
                            month = period
                            member = archive.open(f"{period}_Compras.csv", "w", force_zip64=True)
                            member.write(header)
                        charset = "iso-8859-1" if int(period) % 2 == 0 else "utf-8"
                        member.write(b"\r\n" + line.encode(charset))
                if member:
                    member.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

        line = F.concat_ws(";", *[_quoted(name) for name in PURCHASE_HEADER])
        (
            v.raw_purchases()
            .select("competencia", line.alias("linha"))
            .repartitionByRange("competencia", "linha")
            .sortWithinPartitions("competencia")
            .mapInArrow(pack, "path string")
            .write.format("noop")
            .mode("overwrite")
            .save()
        )

    folder = v.landed("compras_zip", write)
    files = v.spark.read.format("binaryFile").load(folder).select("path")
    return [row["path"] for row in files.orderBy("path").collect()]


def _contract_record() -> Column:
    """A contract record out of an event, with absent objects and punctuated supplier ids."""
    known = F.col("event_type") != "error"
    placed = F.col("event_id") % 5 != 0
    user = F.col("user_id")
    serial = F.col("event_id") % 1000
    day = F.date_format("ts", "yyyy-MM-dd")
    sphere = (
        F.when(F.col("event_type") == "click", "F")
        .when(F.col("event_type") == "view", "E")
        .otherwise("M")
    )
    state = F.element_at(
        F.array(F.lit("PR"), F.lit("SC"), F.lit("RS")), (user % 3 + 1).cast("int")
    )
    return F.struct(
        F.col("event_id").cast("string").alias("numeroControlePNCP"),
        F.when(
            known,
            F.struct(
                F.lpad(user.cast("string"), 14, "0").alias("cnpj"),
                F.concat(F.lit("Órgão "), user).alias("razaoSocial"),
                sphere.alias("esferaId"),
            ),
        ).alias("orgaoEntidade"),
        F.when(
            placed,
            F.struct(
                (user % 9).cast("string").alias("codigoUnidade"),
                F.concat(F.lit("Unidade "), user % 9).alias("nomeUnidade"),
                state.alias("ufSigla"),
                (F.lit(4100000) + user).cast("string").alias("codigoIbge"),
            ),
        ).alias("unidadeOrgao"),
        F.concat(F.lpad(serial.cast("string"), 8, "0"), F.lit("/0001-00")).alias("niFornecedor"),
        F.concat(F.lit("Fornecedor "), serial, F.lit(" ção")).alias("nomeRazaoSocialFornecedor"),
        F.concat(F.lit("Objeto "), F.from_json("props", "k int")["k"]).alias("objetoContrato"),
        F.when(
            F.col("event_type") != "signup",
            F.struct(F.lit(1).alias("id"), F.lit("Contrato").alias("nome")),
        ).alias("tipoContrato"),
        F.col("value").alias("valorInicial"),
        F.col("value").alias("valorGlobal"),
        day.alias("dataAssinatura"),
        day.alias("dataVigenciaInicio"),
        F.date_format(F.date_add(F.col("ts").cast("date"), 365), "yyyy-MM-dd").alias(
            "dataVigenciaFim"
        ),
    )


def _pages(v: Standin, record: Column) -> DataFrame:
    """Events as pages of 50 records; event ids are unique, so a page cannot grow."""
    return (
        v.table("events")
        .select(
            F.date_format("ts", "yyyyMM").alias("competencia"),
            F.floor(F.col("event_id") / 50).alias("pagina"),
            record.alias("r"),
        )
        .groupBy("competencia", "pagina")
        .agg(F.collect_list("r").alias("data"))
        .select(
            "competencia", F.to_json(F.struct("data", F.lit(1).alias("totalPaginas"))).alias("value")
        )
    )


def contract_pages(v: Standin) -> str:
    pages = _pages(v, _contract_record())
    return v.landed("contratos_json", lambda f: pages.write.partitionBy("competencia").text(f))


def procurement_pages(v: Standin) -> str:
    record = F.struct(
        F.col("event_id").cast("string").alias("numeroControlePNCP"),
        (F.col("event_id") % 16).cast("int").alias("modalidadeId"),
        F.concat(F.lit("Compra "), "user_id").alias("objetoCompra"),
    )
    pages = _pages(v, record)
    return v.landed("compras_json", lambda f: pages.write.partitionBy("competencia").text(f))


def mixed_lines(v: Standin) -> DataFrame:
    """Every line of every document as bytes: ISO-8859-1 in odd documents where it can be.

    A line whose ISO-8859-1 bytes happen to be valid UTF-8 is ambiguous and stays UTF-8.
    """
    line = F.col("linha")
    latin = F.encode(line, "ISO-8859-1")
    fits = ~line.rlike(r"[^\x00-\x7E\xA0-\xFF]")
    ambiguous = F.is_valid_utf8(latin.cast("string"))
    return (
        v.spread("documents")
        .select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("linha_no", "linha"))
        .select(
            "doc_id",
            "linha_no",
            F.when((F.col("doc_id") % 2 == 1) & fits & ~ambiguous, latin)
            .otherwise(line.cast("binary"))
            .alias("bytes"),
        )
    )


def snapshot_files(v: Standin) -> DataFrame:
    """Daily snapshot names, one base per event type."""
    return (
        v.table("events")
        .select(
            F.concat_ws("_", F.date_format("ts", "yyyyMMdd"), "event_type").alias("nome")
        )
        .distinct()
        .select(F.concat("nome", F.lit(".zip")).alias("arquivo"))
    )


def purchase_files(v: Standin) -> DataFrame:
    """Names of the monthly archives that exist."""
    return (
        v.table("lineitem")
        .select(F.date_format("l_shipdate", "yyyyMM").alias("mes"))
        .distinct()
        .select(F.concat("mes", F.lit("_compras.zip")).alias("arquivo"))
    )
