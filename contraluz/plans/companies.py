"""Questions about companies: names, search, company sheet, badge and audit.

Every function answers for all companies at once; pass ``roots`` to restrict it to a batch.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.operators.dedup import keep_top
from contraluz.plans.contracts import running, with_root
from contraluz.plans.register import head_offices


def _only(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df
    return df.join(roots.select("cnpj_basico"), "cnpj_basico", "left_semi").select(*df.columns)


def names(companies: DataFrame, sanctions: DataFrame, contracts: DataFrame) -> DataFrame:
    """All known names of a company with their priority: register, sanctions, contracts."""
    register = companies.select(
        "cnpj_basico", F.col("razao_social").alias("nome"), F.lit(1).alias("prioridade")
    )
    sanctioned = sanctions.select(
        text.company_root(F.col("cnpj_cpf")).alias("cnpj_basico"),
        "nome",
        F.lit(2).alias("prioridade"),
    )
    contracted = with_root(contracts).select(
        F.col("raiz").alias("cnpj_basico"),
        F.col("nome_contratado").alias("nome"),
        F.lit(3).alias("prioridade"),
    )
    everything = register.unionByName(sanctioned).unionByName(contracted)
    return everything.filter(F.col("cnpj_basico").isNotNull() & F.col("nome").isNotNull())


def best_name(all_names: DataFrame) -> DataFrame:
    """The name of best priority per company; equal priorities resolve to the smallest name.

    A company repeats the same name in all its contracts, so duplicates go first (by hash, before
    the shuffle) and the sort-based minimum sees few rows.
    """
    return (
        all_names.distinct()
        .groupBy("cnpj_basico")
        .agg(F.min(F.struct("prioridade", "nome")).alias("m"))
        .select("cnpj_basico", F.col("m.nome").alias("nome"), F.col("m.prioridade").alias("prioridade"))
    )


def names_of(all_names: DataFrame, roots: DataFrame) -> DataFrame:
    """The names of ``roots(cnpj_basico)``.

    An inner join with distinct roots, as a semi join would be pushed below the union of the names: Spark
    4.1 then takes the union for partitioned by company and, once the joins below it are changed at run
    time, joins 36 partitions with 12.
    """
    return all_names.join(roots.select("cnpj_basico").distinct(), "cnpj_basico").select(*all_names.columns)


def search(
    all_names: DataFrame,
    establishments: DataFrame,
    risk_per_company: DataFrame,
    query: str,
    limit: int | None = None,
) -> DataFrame:
    """Companies by root (8 or more digits typed) or by part of a name, alerts first.

    Accents and case do not matter; ``%`` and ``_`` work as wildcards. The name filter is one scan;
    only the matching companies are grouped and joined.
    """
    root = typed_root(query)
    if root is not None:
        wanted = F.col("cnpj_basico") == root
    else:
        pattern = F.concat(F.lit("%"), text.normalize_name(F.lit(query)), F.lit("%"))
        wanted = like(text.normalize_name(F.col("nome")), pattern)
    return listed(all_names.filter(wanted), establishments, risk_per_company, limit)


def typed_root(query: str) -> str | None:
    """The company root that is typed, if there are 8 or more digits."""
    digits = re.sub(r"\D", "", query, flags=re.ASCII)
    return digits[:8] if len(digits) >= 8 else None


def listed(
    matching_names: DataFrame,
    establishments: DataFrame,
    risk_per_company: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """One row for each company of the matching names, under the best of these, alerts first."""
    found = best_name(matching_names).select("cnpj_basico", F.col("nome").alias("razao_social"))
    offices = head_offices(establishments).select("cnpj_basico", "uf", "situacao_cadastral")
    rows = (
        found.join(offices, "cnpj_basico", "left")
        .distinct()
        .join(risk_per_company, "cnpj_basico", "left")
        .select(
            "cnpj_basico",
            "razao_social",
            "uf",
            "situacao_cadastral",
            "grau",
            F.coalesce("indicio_sucessora", F.lit(False)).alias("indicio_sucessora"),
        )
        .orderBy(F.asc_nulls_last("grau"), "razao_social", "cnpj_basico")
    )
    return rows if limit is None else rows.limit(limit)


def like(value, pattern):
    # no escape character: a backslash typed by the user is just a backslash
    return F.like(value, pattern, F.lit("\u0001"))


def known_roots(
    all_names: DataFrame, partners: DataFrame, risk: DataFrame, roots: DataFrame | None = None
) -> DataFrame:
    """Companies a sheet exists for: named anywhere, or present among partners or in the risk table."""
    parts = [df.select("cnpj_basico") for df in (all_names, partners, risk)]
    merged = parts[0].union(parts[1]).union(parts[2])
    return _only(merged, roots).distinct()


def sheet_registration(
    companies: DataFrame,
    establishments: DataFrame,
    all_names: DataFrame,
    known: DataFrame,
) -> DataFrame:
    """Register data; without it the best known name; without that the bare root."""
    register = companies.withColumn("_cadastro", F.lit(True))
    offices = head_offices(establishments).select(
        "cnpj_basico",
        "cnpj",
        "nome_fantasia",
        "situacao_cadastral",
        "data_inicio_atividade",
        "cnae_principal",
        "uf",
        "municipio_codigo",
    )
    registered = register.join(offices, "cnpj_basico", "left")
    in_register = F.coalesce("_cadastro", F.lit(False))
    return (
        known.join(registered, "cnpj_basico", "left")
        .join(best_name(all_names).select("cnpj_basico", "nome"), "cnpj_basico", "left")
        .select(
            "cnpj_basico",
            F.when(in_register, F.col("razao_social")).otherwise(F.col("nome")).alias("razao_social"),
            "natureza_juridica",
            "capital_social",
            "porte",
            "cnpj",
            "nome_fantasia",
            "situacao_cadastral",
            text.status_label(F.col("situacao_cadastral")).alias("situacao"),
            "data_inicio_atividade",
            "cnae_principal",
            "uf",
            "municipio_codigo",
            in_register.alias("cadastro_receita_disponivel"),
        )
    )


def by_company(df: DataFrame, *order) -> DataFrame:
    """Rows of a company side by side and in order; there is no order between companies.

    Cheaper than sorting the whole table. A company far beyond the usual size is dealt to several tasks.
    """
    return df.hint("rebalance", "cnpj_basico").sortWithinPartitions("cnpj_basico", *order)


def sheet_risk(risk: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    return by_company(
        _only(risk, roots), "grau", F.desc("indicio_sucessora"), "relacionada", "socio_comum"
    )


def sheet_sanctions(sanctions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    rows = sanctions.withColumn("cnpj_basico", text.company_root(F.col("cnpj_cpf"))).filter(
        F.col("cnpj_basico").isNotNull()
    )
    shown = _only(rows, roots).select(
        "cnpj_basico", "fonte", "categoria", "orgao", "uf_orgao", "esfera_orgao",
        "data_inicio", "data_fim", "vigente", "processo", "cnpj_cpf",
    )
    return by_company(
        shown, F.desc("vigente"), F.desc_nulls_last("data_inicio"), F.col("fonte"), F.col("processo")
    )


def sheet_contracts(
    contracts: DataFrame, roots: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """The contracts of every company, or its ``limit`` of highest value."""
    rows = (
        with_root(contracts)
        .filter(F.col("raiz").isNotNull())
        .select(
            F.col("raiz").alias("cnpj_basico"), "origem", "esfera", "numero_contrato", "orgao",
            "objeto", "situacao", "modalidade", "valor_final", "data_inicio_vigencia",
            "data_fim_vigencia", "cnpj_contratado",
        )
        .withColumn("objeto_limpo", text.clean_object_text(F.col("objeto")))
    )
    order = [F.desc_nulls_last("valor_final"), F.asc("numero_contrato"), F.asc("cnpj_contratado")]
    return keep_top(_only(rows, roots), ["cnpj_basico"], order, limit)


def sheet_partners(partners: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    shown = _only(partners, roots).select(
        "cnpj_basico", "nome_socio", "cpf_mascarado", "qualificacao", "data_entrada"
    )
    return by_company(shown, "nome_socio", "cpf_mascarado")


def badge(known: DataFrame, risk_per_company: DataFrame) -> DataFrame:
    """Worst degree, successor flag and risk label of every known company."""
    successor = F.coalesce("indicio_sucessora", F.lit(False))
    return known.join(risk_per_company, "cnpj_basico", "left").select(
        "cnpj_basico",
        "grau",
        successor.alias("indicio_sucessora"),
        text.risk_badge(F.col("grau"), successor).alias("selo"),
    )


def audit_sheet(
    sanctions: DataFrame,
    contracts: DataFrame,
    partners: DataFrame,
    risk_per_company: DataFrame,
    as_of: date,
    roots: DataFrame | None = None,
) -> DataFrame:
    """Degree, sanctions, contracts and partners per company.

    The four measures are stacked and summed in one aggregation: one shuffle, no join to fan out.
    """
    by_sanction = sanctions.select(
        text.company_root(F.col("cnpj_cpf")).alias("cnpj_basico"),
        F.lit(1).alias("sancoes"),
        F.col("vigente").cast("int").alias("sancoes_vigentes"),
    )
    by_contract = with_root(contracts).select(
        F.col("raiz").alias("cnpj_basico"),
        F.lit(1).alias("contratos"),
        F.col("valor_final").alias("valor"),
        F.coalesce(running(as_of), F.lit(False)).cast("int").alias("contratos_vigentes"),
    )
    by_partner = partners.select("cnpj_basico", F.lit(1).alias("socios"))
    by_risk = risk_per_company.select("cnpj_basico", "grau")
    stacked = by_risk
    for part in (by_sanction, by_contract, by_partner):
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    counts = ["sancoes", "sancoes_vigentes", "contratos", "contratos_vigentes", "socios"]
    return (
        _only(stacked.filter(F.col("cnpj_basico").isNotNull()), roots)
        .groupBy("cnpj_basico")
        .agg(
            F.min("grau").alias("grau"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
            F.coalesce(F.sum("valor"), F.lit(0)).cast("decimal(38,2)").alias("valor_contratos"),
        )
    )
