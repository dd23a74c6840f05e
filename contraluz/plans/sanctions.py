"""One sanctions table from the four public registers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.operators.dedup import keep_top, remaining_order
from contraluz.schemas import MONEY

KEY = ["fonte", "cnpj_cpf", "processo", "categoria", "data_inicio"]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _layout(
    raw: DataFrame,
    source: str,
    *,
    person: Column,
    identifier: str,
    name: Column,
    category: Column,
    agency: str,
    agency_state: Column,
    agency_sphere: Column,
    start: Column,
    end: Column,
    case: str,
    basis: str,
    fine: Column | None = None,
) -> DataFrame:
    return raw.select(
        F.lit(source).alias("fonte"),
        person.alias("tipo_pessoa"),
        text.digits_only(F.col(identifier)).alias("cnpj_cpf"),
        name.alias("nome"),
        text.normalize_name(name).alias("nome_normalizado"),
        category.alias("categoria"),
        F.col(agency).alias("orgao"),
        agency_state.alias("uf_orgao"),
        agency_sphere.alias("esfera_orgao"),
        start.alias("data_inicio"),
        end.alias("data_fim"),
        F.col(case).alias("processo"),
        F.col(basis).alias("fundamentacao"),
        (F.lit(None).cast(MONEY) if fine is None else fine).alias("valor_multa"),
    )


def _first_name(legal: str, fallback: str) -> Column:
    return F.coalesce(text.blank_to_null(F.col(legal)), F.col(fallback))


def from_ceis_layout(raw: DataFrame, source: str, fine: Column | None = None) -> DataFrame:
    """CEIS and CNEP share a layout; CNEP adds a fine."""
    return _layout(
        raw,
        source,
        person=F.col("TIPO DE PESSOA"),
        identifier="CPF OU CNPJ DO SANCIONADO",
        name=_first_name("RAZÃO SOCIAL - CADASTRO RECEITA", "NOME DO SANCIONADO"),
        category=F.col("CATEGORIA DA SANÇÃO"),
        agency="ÓRGÃO SANCIONADOR",
        agency_state=F.col("UF ÓRGÃO SANCIONADOR"),
        agency_sphere=F.col("ESFERA ÓRGÃO SANCIONADOR"),
        start=text.parse_date_br(F.col("DATA INÍCIO SANÇÃO")),
        end=text.parse_date_br(F.col("DATA FINAL SANÇÃO")),
        case="NÚMERO DO PROCESSO",
        basis="FUNDAMENTAÇÃO LEGAL",
        fine=fine,
    )


def from_cepim_layout(raw: DataFrame) -> DataFrame:
    """Non-profits barred from transfers. The register has no dates."""
    return _layout(
        raw,
        "CEPIM",
        person=F.lit("Jurídica"),
        identifier="CNPJ ENTIDADE",
        name=F.col("NOME ENTIDADE"),
        category=F.lit("Entidade impedida (CEPIM)"),
        agency="ÓRGÃO CONCEDENTE",
        agency_state=_null("string"),
        agency_sphere=F.lit("FEDERAL"),
        start=_null("date"),
        end=_null("date"),
        case="NÚMERO CONVÊNIO",
        basis="MOTIVO DO IMPEDIMENTO",
    )


def from_leniency_layout(raw: DataFrame) -> DataFrame:
    """Leniency agreements, one row per company and agreement."""
    return _layout(
        raw,
        "LENIENCIA",
        person=F.lit("Jurídica"),
        identifier="CNPJ DO SANCIONADO",
        name=_first_name("RAZÃO SOCIAL - CADASTRO RECEITA", "NOME FANTASIA - CADASTRO RECEITA"),
        category=F.concat(
            F.lit("Acordo de leniência ("), F.col("SITUAÇÃO DO ACORDO DE LENIÊNICA"), F.lit(")")
        ),
        agency="ÓRGÃO SANCIONADOR",
        agency_state=_null("string"),
        agency_sphere=F.lit("FEDERAL"),
        start=text.parse_date_br(F.col("DATA DE INÍCIO DO ACORDO")),
        end=text.parse_date_br(F.col("DATA DE FIM DO ACORDO")),
        case="NÚMERO DO PROCESSO",
        basis="TERMOS DO ACORDO",
    )


def unify_sanctions(
    ceis: DataFrame, cnep: DataFrame, cepim: DataFrame, leniency: DataFrame, as_of: date
) -> DataFrame:
    """The sanctions table: common layout, one row per key, in-force flag as of a date.

    Duplicates of a key are resolved by the remaining columns in ascending order, so reruns and
    other engines pick the same row.
    """
    fine = text.parse_money_br(F.col("VALOR DA MULTA"))
    everything = (
        from_ceis_layout(ceis, "CEIS")
        .unionByName(from_ceis_layout(cnep, "CNEP", fine))
        .unionByName(from_cepim_layout(cepim))
        .unionByName(from_leniency_layout(leniency))
        .filter(F.col("cnpj_cpf") != "")
    )
    unique = keep_top(everything, KEY, remaining_order(everything, KEY))
    return with_in_force(unique, as_of)


def with_in_force(sanctions: DataFrame, as_of: date) -> DataFrame:
    """Open-ended sanctions and those ending on or after ``as_of`` are in force."""
    end = F.col("data_fim")
    return sanctions.withColumn("vigente", end.isNull() | (end >= F.lit(as_of)))


def count_by_source(sanctions: DataFrame) -> DataFrame:
    return sanctions.groupBy("fonte").agg(F.count(F.lit(1)).alias("registros"))


def classify(sanctions: DataFrame) -> DataFrame:
    """Each sanction with its plain-language class."""
    return sanctions.withColumn("classe", text.sanction_class(F.col("categoria")))
