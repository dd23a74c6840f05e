"""Possible successor companies, ranked by the strength of the case.

Indications for human review, never accusations. The published criteria are severity of the
sanction, active status, public contracts (running ones above all) and link confidence; the
weights below are this library's own.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.plans.companies import best_name, names_of
from contraluz.plans.contracts import running, with_root
from contraluz.plans.register import head_offices

SEVERITY = {
    "INIDONEIDADE": 3,
    "LENIENCIA": 3,
    "SUSPENSAO": 2,
    "IMPEDIMENTO": 2,
}
SEVERITY_DEFAULT = 1
ACTIVE_WEIGHT = 2
CONTRACTS_WEIGHT = 1
RUNNING_WEIGHT = 2
HIGH_CONFIDENCE_WEIGHT = 1


def severity(category: Column) -> Column:
    chain = F
    found = text.sanction_class(category)
    for code, weight in SEVERITY.items():
        chain = chain.when(found == code, F.lit(weight))
    return chain.otherwise(F.lit(SEVERITY_DEFAULT))


def successor_candidates(
    risk: DataFrame,
    sanctions: DataFrame,
    contracts: DataFrame,
    establishments: DataFrame,
    all_names: DataFrame,
    as_of: date,
) -> DataFrame:
    """One row per (candidate, sanctioned company, partner) with its strength.

    Candidates are few next to the inputs, so every input is cut down to them before it is
    aggregated.
    """
    candidates = risk.filter("indicio_sucessora").drop("grau", "indicio_sucessora")
    roots = candidates.select("cnpj_basico").distinct()
    related = candidates.select(F.col("relacionada").alias("cnpj_basico")).distinct()

    worst = (
        sanctions.filter("vigente")
        .select(
            text.company_root(F.col("cnpj_cpf")).alias("cnpj_basico"), "categoria", "data_inicio"
        )
        .join(related, "cnpj_basico", "left_semi")
        .groupBy("cnpj_basico")
        .agg(
            F.min(F.struct((-severity(F.col("categoria"))).alias("s"), "categoria")).alias("m"),
            F.min("data_inicio").alias("sancao_desde"),
        )
        .select(
            F.col("cnpj_basico").alias("relacionada"),
            (-F.col("m.s")).alias("gravidade"),
            F.col("m.categoria").alias("categoria"),
            "sancao_desde",
        )
    )
    signed = (
        with_root(contracts)
        .withColumn("cnpj_basico", F.col("raiz"))
        .join(roots, "cnpj_basico", "left_semi")
        .groupBy("cnpj_basico")
        .agg(
            F.count(F.lit(1)).alias("contratos"),
            F.sum("valor_final").cast("decimal(38,2)").alias("valor_contratos"),
            F.count_if(running(as_of)).alias("contratos_vigentes"),
        )
    )
    offices = head_offices(establishments).select(
        "cnpj_basico", "situacao_cadastral", "data_inicio_atividade", "uf"
    )
    ends = F.explode(F.array("cnpj_basico", "relacionada")).alias("cnpj_basico")
    labels = best_name(names_of(all_names, candidates.select(ends)))
    own = labels.select("cnpj_basico", F.col("nome").alias("razao_social"))
    other = labels.select(
        F.col("cnpj_basico").alias("relacionada"), F.col("nome").alias("razao_social_relacionada")
    )
    zero = F.lit(0).cast("long")
    strength = (
        F.coalesce("gravidade", F.lit(SEVERITY_DEFAULT))
        + F.when(F.col("situacao_cadastral") == "02", ACTIVE_WEIGHT).otherwise(0)
        + F.when(F.col("contratos") > 0, CONTRACTS_WEIGHT).otherwise(0)
        + F.when(F.col("contratos_vigentes") > 0, RUNNING_WEIGHT).otherwise(0)
        + F.when(F.col("confianca") == "alta", HIGH_CONFIDENCE_WEIGHT).otherwise(0)
    )
    return (
        candidates.join(worst, "relacionada", "left")
        .join(offices, "cnpj_basico", "left")
        .join(signed, "cnpj_basico", "left")
        .join(own, "cnpj_basico", "left")
        .join(other, "relacionada", "left")
        .select(
            "cnpj_basico",
            "razao_social",
            "data_inicio_atividade",
            "uf",
            "socio_comum",
            "confianca",
            "relacionada",
            "razao_social_relacionada",
            "categoria",
            "sancao_desde",
            F.coalesce("contratos", zero).alias("contratos"),
            F.coalesce("valor_contratos", F.lit(0)).cast("decimal(38,2)").alias("valor_contratos"),
            F.coalesce("contratos_vigentes", zero).alias("contratos_vigentes"),
            strength.alias("forca"),
        )
        .orderBy(F.desc("forca"), F.desc("valor_contratos"), "cnpj_basico", "relacionada", "socio_comum")
    )


def export_candidates(ranked: DataFrame, folder: str) -> None:
    """Write the ranked list as CSV with a header; files follow the ranking order."""
    ranked.write.mode("overwrite").csv(folder, header=True)
