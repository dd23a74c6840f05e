"""Company register: typed tables and their reduction to the companies that matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.functions import text


def partners_from_raw(raw: DataFrame) -> DataFrame:
    """Partner rows with normalised name and matching key; blank names are dropped."""
    name = F.col("nome_socio")
    return raw.filter(F.trim(name) != "").select(
        "cnpj_basico",
        "identificador_socio",
        text.normalize_name(name).alias("nome_socio"),
        F.col("cnpj_cpf_socio").alias("cpf_mascarado"),
        F.col("qualificacao_socio").alias("qualificacao"),
        text.parse_date_compact(F.col("data_entrada")).alias("data_entrada"),
        text.partner_key(name, F.col("cnpj_cpf_socio")).alias("chave_socio"),
    )


def companies_from_raw(raw: DataFrame) -> DataFrame:
    return raw.select(
        "cnpj_basico",
        "razao_social",
        "natureza_juridica",
        text.parse_decimal_comma(F.col("capital_social")).alias("capital_social"),
        "porte",
    )


def establishments_from_raw(raw: DataFrame) -> DataFrame:
    """Establishments with the 14-digit id composed of root, order and check digits."""
    return raw.select(
        F.concat("cnpj_basico", "cnpj_ordem", "cnpj_dv").alias("cnpj"),
        "cnpj_basico",
        "matriz_filial",
        "nome_fantasia",
        "situacao_cadastral",
        text.parse_date_compact(F.col("data_inicio_atividade")).alias("data_inicio_atividade"),
        "cnae_principal",
        "uf",
        F.col("municipio").alias("municipio_codigo"),
    )


def head_offices(establishments: DataFrame) -> DataFrame:
    return establishments.filter(F.col("matriz_filial") == "1")


def sanctioned_roots(sanctions: DataFrame) -> DataFrame:
    """Roots with any sanction, in force or not."""
    root = text.company_root(F.col("cnpj_cpf"))
    return sanctions.select(root.alias("cnpj_basico")).filter("cnpj_basico is not null").distinct()


def contracted_roots(contracts: DataFrame) -> DataFrame:
    root = text.company_root(F.col("cnpj_contratado"))
    return contracts.select(root.alias("cnpj_basico")).filter("cnpj_basico is not null").distinct()


def universe_base(sanctions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Companies sanctioned or contracted."""
    return sanctioned_roots(sanctions).union(contracted_roots(contracts)).distinct()


def usable_key(key: Column) -> Column:
    """The key carries a document that is neither absent nor zeroed."""
    return ~key.endswith("|") & ~key.endswith("|000000")


def universe_neighbors(sanctions: DataFrame, partners: DataFrame) -> DataFrame:
    """Companies sharing a usable partner key with a sanctioned one.

    Only the reduced (key, company) table is shuffled, once per key column.
    """
    held = (
        partners.filter(usable_key(F.col("chave_socio")))
        .select("chave_socio", "cnpj_basico")
        .distinct()
    )
    keys = (
        held.join(sanctioned_roots(sanctions), "cnpj_basico", "left_semi")
        .select("chave_socio")
        .distinct()
    )
    return held.join(keys, "chave_socio", "left_semi").select("cnpj_basico").distinct()


def universe(sanctions: DataFrame, contracts: DataFrame, partners: DataFrame) -> DataFrame:
    base = sanctioned_roots(sanctions).union(contracted_roots(contracts))
    return base.union(universe_neighbors(sanctions, partners)).distinct()


def restrict(register: DataFrame, roots: DataFrame) -> DataFrame:
    """Register rows of the given companies. Spark broadcasts ``roots`` when its size allows."""
    return register.join(roots.select("cnpj_basico"), "cnpj_basico", "left_semi").select(
        *register.columns
    )
