"""Risk degrees. 0: sanction in force. 1: shares a partner with a degree 0 and is not one itself.

2, on request: shares a partner with a degree 1, or had a sanction that expired lately.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text
from contraluz.operators.hot_groups import CELL_ROWS
from contraluz.plans.links import (
    HYPERCONNECTOR_LIMIT,
    best_confidence,
    documented,
    links_from,
    medium_links_seen,
)
from contraluz.plans.register import head_offices
from contraluz.tables import staged


def degree0(sanctions: DataFrame) -> DataFrame:
    """Companies with a sanction in force and the earliest start among those sanctions."""
    return (
        sanctions.filter("vigente")
        .select(text.company_root(F.col("cnpj_cpf")).alias("cnpj_basico"), "data_inicio")
        .filter("cnpj_basico is not null")
        .groupBy("cnpj_basico")
        .agg(F.min("data_inicio").alias("primeira_sancao_vigente"))
    )


def risk_edges(
    held: DataFrame,
    sanctioned: DataFrame,
    limit: int = HYPERCONNECTOR_LIMIT,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Links that touch a degree-0 company, from the other company's side."""
    origins = sanctioned.select("cnpj_basico")
    return links_from(held, origins, limit, cell_rows).select(
        F.col("outra").alias("cnpj_basico"),
        F.col("origem").alias("relacionada"),
        "socio_comum",
        "confianca",
    )


def _office(establishments: DataFrame, prefix: str) -> DataFrame:
    return head_offices(establishments).select(
        F.col("cnpj_basico").alias(f"{prefix}_raiz"),
        F.col("cnae_principal").alias(f"{prefix}_cnae"),
        F.col("municipio_codigo").alias(f"{prefix}_municipio"),
        F.col("data_inicio_atividade").alias(f"{prefix}_inicio"),
    )


def _signal() -> Column:
    """Opened after the related company's first sanction, same industry, same city."""
    return F.coalesce(
        (F.col("m_inicio") > F.col("primeira_sancao_vigente"))
        & (F.col("m_cnae") == F.col("r_cnae"))
        & (F.col("m_municipio") == F.col("r_municipio")),
        F.lit(False),
    )


def with_successor_signal(
    edges: DataFrame, sanctioned: DataFrame, establishments: DataFrame
) -> DataFrame:
    """Edges with the possible-successor signal; one row per (company, related, partner).

    The related side joins the small table of sanctioned companies with their head office, so the
    whole register is joined once, on the company side.
    """
    related = (
        sanctioned.withColumnRenamed("cnpj_basico", "relacionada")
        .join(_office(establishments, "r"), F.col("relacionada") == F.col("r_raiz"), "left")
        .select("relacionada", "primeira_sancao_vigente", "r_cnae", "r_municipio")
    )
    own = _office(establishments, "m").withColumnRenamed("m_raiz", "cnpj_basico")
    return (
        edges.join(related, "relacionada")
        .join(own, "cnpj_basico", "left")
        .groupBy("cnpj_basico", "relacionada", "socio_comum")
        .agg(best_confidence(), F.bool_or(_signal()).alias("indicio_sucessora"))
    )


def risk_degrees(
    held: DataFrame,
    sanctioned: DataFrame,
    establishments: DataFrame,
    limit: int = HYPERCONNECTOR_LIMIT,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The risk table: one row per degree-0 company, one per (degree-1 company, related, partner)."""
    edges = risk_edges(held, sanctioned, limit, cell_rows).join(
        sanctioned.select("cnpj_basico"), "cnpj_basico", "left_anti"
    )
    one = with_successor_signal(edges, sanctioned, establishments).select(
        "cnpj_basico",
        F.lit(1).alias("grau"),
        "relacionada",
        "socio_comum",
        "confianca",
        "indicio_sucessora",
    )
    none = F.lit(None).cast("string")
    zero = sanctioned.select(
        "cnpj_basico",
        F.lit(0).alias("grau"),
        none.alias("relacionada"),
        none.alias("socio_comum"),
        none.alias("confianca"),
        F.lit(False).alias("indicio_sucessora"),
    )
    return zero.unionByName(one)


def company_risk(
    held: DataFrame,
    sanctioned: DataFrame,
    establishments: DataFrame,
    limit: int = HYPERCONNECTOR_LIMIT,
) -> DataFrame:
    """One row per company: worst degree and whether any successor signal exists.

    Equal to grouping :func:`risk_degrees` by company, but linear in the partner table: a group
    is reduced to "has a degree 0" and to the earliest sanction per industry and city before its
    members are looked up, so no pair is built for high-confidence groups of any size.
    """
    names = ["nome_socio", "doc"]
    docs = documented(held)
    mine = docs.join(sanctioned, "cnpj_basico")
    touched = mine.select(*names).distinct()
    exposed = docs.join(touched, names, "left_semi")

    place = ["cnae", "municipio"]
    offices = head_offices(establishments).select(
        "cnpj_basico",
        F.col("cnae_principal").alias("cnae"),
        F.col("municipio_codigo").alias("municipio"),
        "data_inicio_atividade",
    )
    earliest = (
        mine.join(offices, "cnpj_basico")
        .groupBy(*names, *place)
        .agg(F.min("primeira_sancao_vigente").alias("primeira"))
        .filter("primeira is not null")
    )
    successors = (
        exposed.join(offices, "cnpj_basico")
        .join(earliest, [*names, *place])
        .filter(F.col("data_inicio_atividade") > F.col("primeira"))
    )
    medium = with_successor_signal(
        medium_links_seen(held, sanctioned.select("cnpj_basico"), limit).select(
            F.col("outra").alias("cnpj_basico"),
            F.col("origem").alias("relacionada"),
            "socio_comum",
            "confianca",
        ),
        sanctioned,
        establishments,
    )

    def rows(df: DataFrame, degree: int, signal: Column) -> DataFrame:
        return df.select("cnpj_basico", F.lit(degree).alias("grau"), signal.alias("indicio"))

    everything = (
        rows(sanctioned, 0, F.lit(False))
        .unionByName(rows(exposed, 1, F.lit(False)))
        .unionByName(rows(successors, 1, F.lit(True)))
        .unionByName(rows(medium, 1, F.col("indicio_sucessora")))
    )
    return everything.groupBy("cnpj_basico").agg(
        F.min("grau").alias("grau"),
        # a sanctioned company is degree 0 only and carries no signal
        (F.bool_or("indicio") & (F.min("grau") == 1)).alias("indicio_sucessora"),
    )


def linked_companies(
    held: DataFrame, frontier: DataFrame, limit: int | None = HYPERCONNECTOR_LIMIT
) -> DataFrame:
    """Companies linked to one of ``frontier(cnpj_basico)``, and some of it itself; distinct.

    High-confidence groups are reduced to "has a company of the frontier", so no pair is made there.
    """
    names = ["nome_socio", "doc"]
    docs = documented(held)
    touched = docs.join(frontier, "cnpj_basico", "left_semi").select(*names).distinct()
    high = docs.join(touched, names, "left_semi").select("cnpj_basico")
    medium = medium_links_seen(held, frontier.select("cnpj_basico"), limit)
    return high.union(medium.select("outra")).distinct()


def risk_by_hops(
    held: DataFrame,
    sanctioned: DataFrame,
    hops: int = 2,
    limit: int | None = HYPERCONNECTOR_LIMIT,
) -> DataFrame:
    """``(cnpj_basico, grau)``: how many links a company is away from a sanctioned one, at most ``hops``.

    Each round expands the companies that the last one reached first; they are written, and only
    those not reached before go on.
    """
    reached = frontier = staged(sanctioned.select("cnpj_basico", F.lit(0).alias("grau")), "grau0")
    for degree in range(1, hops + 1):
        near = linked_companies(held, frontier.select("cnpj_basico"), limit)
        fresh = near.join(reached, "cnpj_basico", "left_anti")
        frontier = staged(fresh.select("cnpj_basico", F.lit(degree).alias("grau")), f"grau{degree}")
        reached = reached.unionByName(frontier)
    return reached


def recently_expired(sanctions: DataFrame, as_of: date, years: int) -> DataFrame:
    """Companies with a sanction that ended less than ``years`` years before ``as_of``, and its last day."""
    since = F.add_months(F.lit(as_of), -12 * years)
    return (
        sanctions.filter(~F.col("vigente") & (F.col("data_fim") > since))
        .select(text.company_root(F.col("cnpj_cpf")).alias("cnpj_basico"), "data_fim")
        .filter("cnpj_basico is not null")
        .groupBy("cnpj_basico")
        .agg(F.max("data_fim").alias("fim_da_sancao"))
    )


def degree2(
    held: DataFrame,
    sanctions: DataFrame,
    sanctioned: DataFrame,
    as_of: date,
    years: int,
    limit: int | None = HYPERCONNECTOR_LIMIT,
) -> DataFrame:
    """Companies of degree 2: a partner in common with a degree 1, or a sanction that expired lately.

    None of them is of degree 0 or 1. ``socio_de_grau1`` and ``fim_da_sancao`` say why.
    """
    levels = risk_by_hops(held, sanctioned, 2, limit)
    closer = levels.filter("grau < 2")
    linked = levels.filter("grau = 2").select("cnpj_basico", F.lit(True).alias("socio_de_grau1"))
    late = recently_expired(sanctions, as_of, years).join(closer, "cnpj_basico", "left_anti")
    return linked.join(late, "cnpj_basico", "full").select(
        "cnpj_basico",
        F.lit(2).alias("grau"),
        F.coalesce("socio_de_grau1", F.lit(False)).alias("socio_de_grau1"),
        "fim_da_sancao",
    )


def count_company_risk(risk_per_company: DataFrame) -> DataFrame:
    """Load metrics: companies at degree 0, at degree 1, with a successor signal."""
    return risk_per_company.agg(
        F.count_if(F.col("grau") == 0).alias("grau0"),
        F.count_if(F.col("grau") == 1).alias("grau1"),
        F.count_if("indicio_sucessora").alias("indicio_sucessora"),
    )
