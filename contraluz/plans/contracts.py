"""One contracts table from the monthly purchase files and the contract JSON records."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.operators.dedup import keep_top, remaining_order
from contraluz.schemas import CONTRACTS

VERSION_KEY = ["numero_contrato", "ug_codigo", "cnpj_contratado"]
SPHERES = ("F", "E", "M")


def _null(name: str) -> Column:
    return F.lit(None).cast(CONTRACTS[name].dataType).alias(name)


def from_purchases(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Federal purchase rows (official header plus ``competencia``) in the contracts layout.

    Columns of ``keep`` stay behind those of the layout.
    """
    name = F.col("Nome Contratado")
    return raw.select(
        F.lit("PORTAL").alias("origem"),
        F.lit("F").alias("esfera"),
        F.col("competencia"),
        F.col("Número do Contrato").alias("numero_contrato"),
        F.col("Código Órgão").alias("orgao_codigo"),
        F.col("Nome Órgão").alias("orgao"),
        F.col("Nome Órgão Superior").alias("orgao_superior"),
        F.col("Código UG").alias("ug_codigo"),
        F.col("Nome UG").alias("ug"),
        _null("uf"),
        _null("municipio_codigo_ibge"),
        text.digits_only(F.col("Código Contratado")).alias("cnpj_contratado"),
        name.alias("nome_contratado"),
        text.normalize_name(name).alias("nome_contratado_normalizado"),
        F.col("Objeto").alias("objeto"),
        F.col("Situação Contrato").alias("situacao"),
        F.col("Modalidade Compra").alias("modalidade"),
        text.parse_money_br(F.col("Valor Inicial Compra")).alias("valor_inicial"),
        text.parse_money_br(F.col("Valor Final Compra")).alias("valor_final"),
        text.parse_date_br(F.col("Data Assinatura Contrato")).alias("data_assinatura"),
        text.parse_date_br(F.col("Data Início Vigência")).alias("data_inicio_vigencia"),
        text.parse_date_br(F.col("Data Fim Vigência")).alias("data_fim_vigencia"),
        *keep,
    ).filter(F.col("cnpj_contratado") != "")


def latest_versions(contracts: DataFrame) -> DataFrame:
    """A contract republished in later months keeps only its newest version.

    Ties inside a month go by agency, higher value, later start, then every other column.
    """
    order = [
        F.col("competencia").desc_nulls_last(),
        F.col("orgao_codigo").asc_nulls_last(),
        F.col("valor_final").desc_nulls_last(),
        F.col("data_inicio_vigencia").desc_nulls_last(),
    ]
    used = [*VERSION_KEY, "competencia", "orgao_codigo", "valor_final", "data_inicio_vigencia"]
    return keep_top(contracts, VERSION_KEY, [*order, *remaining_order(contracts, used)])


def check_spheres(spheres: Sequence[str]) -> list[str]:
    unknown = sorted(set(spheres) - set(SPHERES))
    if unknown:
        raise ValueError(f"unknown spheres {unknown}; use {', '.join(SPHERES)}")
    return list(spheres)


def in_scope(
    records: DataFrame,
    spheres: Sequence[str],
    state: str | None = None,
    city_code: str | None = None,
) -> DataFrame:
    """Contract JSON records of the wanted spheres, state and city; missing values never match."""
    kept = records.filter(F.col("orgaoEntidade.esferaId").isin(check_spheres(spheres)))
    if state:
        kept = kept.filter(F.col("unidadeOrgao.ufSigla") == state)
    if city_code:
        kept = kept.filter(F.col("unidadeOrgao.codigoIbge") == city_code)
    return kept


def from_json_records(records: DataFrame) -> DataFrame:
    """Nested contract records (plus ``competencia``) in the contracts layout.

    Field access on an absent object is null, so no guard is needed. Supplier ids are stripped to
    digits like those of the purchase files, so both sources join on the same form.
    """
    name = F.col("nomeRazaoSocialFornecedor")
    return records.select(
        F.lit("PNCP").alias("origem"),
        F.col("orgaoEntidade.esferaId").alias("esfera"),
        F.col("competencia"),
        F.col("numeroControlePNCP").alias("numero_contrato"),
        F.col("orgaoEntidade.cnpj").alias("orgao_codigo"),
        F.col("orgaoEntidade.razaoSocial").alias("orgao"),
        _null("orgao_superior"),
        F.col("unidadeOrgao.codigoUnidade").alias("ug_codigo"),
        F.col("unidadeOrgao.nomeUnidade").alias("ug"),
        F.col("unidadeOrgao.ufSigla").alias("uf"),
        F.nullif(F.col("unidadeOrgao.codigoIbge"), F.lit("")).alias("municipio_codigo_ibge"),
        text.digits_only(F.col("niFornecedor")).alias("cnpj_contratado"),
        name.alias("nome_contratado"),
        text.normalize_name(name).alias("nome_contratado_normalizado"),
        F.col("objetoContrato").alias("objeto"),
        _null("situacao"),
        F.col("tipoContrato.nome").alias("modalidade"),
        F.col("valorInicial").alias("valor_inicial"),
        F.col("valorGlobal").alias("valor_final"),
        F.col("dataAssinatura").try_cast("date").alias("data_assinatura"),
        F.col("dataVigenciaInicio").try_cast("date").alias("data_inicio_vigencia"),
        F.col("dataVigenciaFim").try_cast("date").alias("data_fim_vigencia"),
    )


def contracts_table(
    spheres: Sequence[str],
    purchases: DataFrame | None = None,
    records: DataFrame | None = None,
    state: str | None = None,
    city_code: str | None = None,
) -> DataFrame:
    """The contracts table for a scope: F comes from purchases, E and M from JSON records."""
    parts = []
    wanted = check_spheres(spheres)
    if "F" in wanted:
        if purchases is None:
            raise ValueError("sphere F needs the purchase files")
        parts.append(latest_versions(from_purchases(purchases)))
    others = [s for s in wanted if s != "F"]
    if others:
        if records is None:
            raise ValueError("spheres E and M need the contract records")
        parts.append(from_json_records(in_scope(records, others, state, city_code)))
    if not parts:
        raise ValueError("no sphere given")
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def count_by_origin(contracts: DataFrame) -> DataFrame:
    return contracts.groupBy("origem").agg(F.count(F.lit(1)).alias("registros"))


def with_root(contracts: DataFrame) -> DataFrame:
    """Add the company root of the supplier; null for persons, who must not match companies."""
    return contracts.withColumn("raiz", text.company_root(F.col("cnpj_contratado")))


def running(as_of: date) -> Column:
    """Contract still in force; an unknown end counts as not running."""
    return F.col("data_fim_vigencia") >= F.lit(as_of)
