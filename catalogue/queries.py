"""The registered queries: each runs one job over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from catalogue import landing
from contraluz.functions import text
from contraluz.functions.charset import repair_bytes
from contraluz.plans import (
    candidates,
    companies,
    contracts,
    graph,
    links,
    monthly,
    register,
    reload,
    reports,
    risk,
    sanctions,
)
from contraluz.schemas import REGISTER_ESTABLISHMENTS
from contraluz.session import scratch_dir
from contraluz.sources import archives, delimited, json_pages, manifest
from contraluz.sources import landing as files
from contraluz.tables import TableStore
from catalogue.standin import Standin

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(build: Callable[[Standin], DataFrame]) -> Callable[[Standin], DataFrame]:
    """Register a function of the stand-in inputs under its own name."""
    REGISTRY[build.__name__] = lambda spark, folder: comparable(build(Standin(spark, folder)))
    return build


def comparable(df: DataFrame) -> DataFrame:
    """Money as double, a type every engine hands over alike. The jobs keep it decimal."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, DecimalType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


# scalar functions


@query
def digits_only(v: Standin) -> DataFrame:
    return v.table("customer").select(
        "c_custkey", text.digits_only(F.col("c_name")).alias("digitos")
    )


@query
def normalize_cnpj(v: Standin) -> DataFrame:
    key = F.col("c_custkey")
    written = (
        F.when(key % 3 == 0, F.regexp_replace(key.cast("string"), r"(\d)$", "-$1"))
        .when(key % 3 == 1, F.lit("sem dígitos"))
        .otherwise(F.concat(F.lit("12.345.678/9012-345"), key))
    )
    return v.table("customer").select("c_custkey", text.normalize_cnpj(written).alias("cnpj"))


@query
def normalize_name(v: Standin) -> DataFrame:
    return v.spread("documents").select(
        "doc_id", text.normalize_name(F.col("text")).alias("nome")
    )


@query
def partner_keys(v: Standin) -> DataFrame:
    return v.build_partners().select("cnpj_basico", "nome_socio", "chave_socio")


def _date_texts(v: Standin) -> DataFrame:
    key, day = F.col("o_orderkey") % 8, F.col("o_orderdate")
    return v.table("orders").select(
        "o_orderkey",
        F.when(key == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(key == 1, F.date_format(day, "d/M/yyyy"))
        .when(key == 2, F.concat(F.lit("  "), F.date_format(day, "dd/MM/yyyy"), F.lit(" ")))
        .when(key == 3, F.lit(""))
        .when(key == 4, F.lit("31/02/1999"))
        .when(key == 5, F.lit("sem data"))
        .when(key == 6, F.date_format(day, "yyyy-MM-dd"))
        .alias("texto"),
    )


@query
def parse_date_br(v: Standin) -> DataFrame:
    return _date_texts(v).select("o_orderkey", text.parse_date_br(F.col("texto")).alias("data"))


@query
def parse_date_compact(v: Standin) -> DataFrame:
    key, day = F.col("o_orderkey") % 6, F.date_format("o_orderdate", "yyyyMMdd")
    written = (
        F.when(key == 0, day)
        .when(key == 1, F.concat(F.lit(" "), day, F.lit(" ")))
        .when(key == 2, F.lit("00000000"))
        .when(key == 3, F.lit("19991331"))
        .when(key == 4, F.lit(""))
    )
    return v.table("orders").select("o_orderkey", text.parse_date_compact(written).alias("data"))


@query
def parse_money_br(v: Standin) -> DataFrame:
    key = F.col("o_orderkey") % 7
    grouped = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    plain = F.replace(grouped, F.lit("."), F.lit(""))
    written = (
        F.when(key == 0, grouped)
        .when(key == 1, F.concat(F.lit(" "), plain, F.lit("  ")))
        .when(key == 2, F.concat(F.lit("-"), plain))
        .when(key == 3, F.lit("R$ 10,00"))
        .when(key == 4, F.lit("   "))
        .when(key == 5, F.concat(plain, F.lit("7")))
    )
    return v.table("orders").select("o_orderkey", text.parse_money_br(written).alias("valor"))


@query
def parse_decimal_comma(v: Standin) -> DataFrame:
    amount = F.translate(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), ".", ",")
    written = F.when(F.col("c_custkey") % 6 == 0, F.lit("mil reais")).otherwise(amount)
    return v.table("customer").select(
        "c_custkey", text.parse_decimal_comma(written).alias("valor")
    )


# sources


@query
def scan_csv_header(v: Standin) -> DataFrame:
    raw = delimited.read_with_header(v.spark, landing.customer_csv(v))
    return raw.select(
        F.col("c_custkey").cast("long").alias("c_custkey"),
        "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"),
        F.col("c_acctbal").cast("double").alias("c_acctbal"),
        "c_mktsegment",
    )


@query
def scan_csv_headerless(v: Standin) -> DataFrame:
    raw = delimited.read_headerless(
        v.spark, landing.establishments_csv(v), REGISTER_ESTABLISHMENTS
    )
    return register.establishments_from_raw(raw)


@query
def header_repair(v: Standin) -> DataFrame:
    raw = delimited.read_with_header(v.spark, landing.leniency_csv(v))
    return sanctions.with_in_force(sanctions.from_leniency_layout(raw), v.as_of)


@query
def contracts_with_period(v: Standin) -> DataFrame:
    raw = delimited.read_with_header(v.spark, landing.purchases_csv(v))
    return contracts.from_purchases(delimited.with_period(raw))


@query
def encoding_repair(v: Standin) -> DataFrame:
    lines = landing.mixed_lines(v)
    return lines.select("doc_id", "linha_no", repair_bytes(F.col("bytes")).alias("linha"))


@query
def zip_csv_scan(v: Standin) -> DataFrame:
    raw = archives.zip_with_header(v.spark, landing.purchases_zip(v), "_compras.csv")
    return contracts.contracts_table(["F"], purchases=delimited.with_period(raw))


@query
def zip_block_scan(v: Standin) -> DataFrame:
    raw = archives.zip_block_with_header(v.spark, landing.purchases_zip(v), "_compras.csv")
    return contracts.contracts_table(["F"], purchases=delimited.with_period(raw))


@query
def scan_csv_split(v: Standin) -> DataFrame:
    """Documents with their line breaks as quoted fields of a few files."""
    raw = delimited.read_split(v.spark, landing.documents_csv(v))
    return raw.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


@query
def latest_snapshot(v: Standin) -> DataFrame:
    return files.latest_snapshots(landing.snapshot_files(v))


@query
def month_range(v: Standin) -> DataFrame:
    """Published rows per month of the range; months without any count as zero."""
    published = v.table("lineitem").groupBy(
        F.date_format("l_shipdate", "yyyyMM").alias("competencia")
    ).agg(F.count(F.lit(1)).alias("n"))
    months = files.month_range(v.spark, "1994-11", v.as_of)
    return months.join(published, "competencia", "left").select(
        "competencia", F.coalesce("n", F.lit(0)).alias("publicados")
    )


@query
def months_since(v: Standin) -> DataFrame:
    return files.since_month(landing.purchase_files(v), "1997-06")


@query
def refresh_plan(v: Standin) -> DataFrame:
    return files.refresh_plan(v.spark, landing.purchase_files(v), "1994-11", v.as_of)


@query
def pncp_pages_explode(v: Standin) -> DataFrame:
    records = json_pages.read_contract_pages(v.spark, landing.contract_pages(v))
    return records.select(
        F.col("numeroControlePNCP").alias("numero"),
        "competencia",
        F.col("orgaoEntidade.esferaId").alias("esfera"),
        F.col("valorGlobal").alias("valor"),
    )


@query
def nested_json_contracts(v: Standin) -> DataFrame:
    records = json_pages.read_contract_pages(v.spark, landing.contract_pages(v))
    return contracts.from_json_records(records)


@query
def contracts_scope(v: Standin) -> DataFrame:
    records = json_pages.read_contract_pages(v.spark, landing.contract_pages(v))
    return contracts.contracts_table(["E", "M"], records=records, state="PR")


@query
def modality_lookup(v: Standin) -> DataFrame:
    return json_pages.read_procurement_pages(v.spark, landing.procurement_pages(v))


# sanctions and contracts


@query
def sanctions_unified(v: Standin) -> DataFrame:
    return v.build_sanctions()


@query
def sanctions_counts(v: Standin) -> DataFrame:
    return sanctions.count_by_source(v.sanctions())


@query
def sanctions_in_force(v: Standin) -> DataFrame:
    return (
        v.sanctions()
        .groupBy("fonte", "vigente")
        .agg(
            F.count(F.lit(1)).alias("registros"),
            F.min("data_inicio").alias("primeira"),
            F.max("data_fim").alias("ultima"),
        )
    )


@query
def sanction_class(v: Standin) -> DataFrame:
    return sanctions.classify(v.sanctions()).select("fonte", "processo", "categoria", "classe")


@query
def contracts_latest(v: Standin) -> DataFrame:
    return v.build_contracts()


def _reloaded(v: Standin) -> TableStore:
    """Tables after the newest months came out again and only these were read."""

    def load(tables: str) -> None:
        store = TableStore(v.spark, tables)
        folder = scratch_dir(v.spark, "recarga_csv")

        def read(paths: list[str]) -> DataFrame:
            raw = delimited.with_period(delimited.read_with_header(v.spark, paths))
            month = manifest.month_of_purchase(F.col("_arquivo")).alias("mes_arquivo")
            return contracts.from_purchases(raw, keep=[month])

        def refresh() -> None:
            landed = files.list_files(v.spark, folder, "*.csv")
            month = manifest.month_of_purchase(F.col("path"))
            source = reload.Source(manifest.entries(landed, reload.PURCHASES, month), read)
            reload.reload_contracts(store, source, None, lambda months: monthly.refresh(store, months))

        newest = landing.publish_early(v, folder)
        refresh()
        landing.publish_again(v, folder, newest)
        refresh()

    return TableStore(v.spark, v.landed("recarga", load))


@query
def contracts_reloaded(v: Standin) -> DataFrame:
    return _reloaded(v).read(reload.CONTRACTS)


@query
def agencies_ranking_incremental(v: Standin) -> DataFrame:
    return monthly.agencies_ranking(_reloaded(v), v.sanctioned())


@query
def radar_incremental(v: Standin) -> DataFrame:
    return monthly.radar_summary(_reloaded(v), v.sanctioned(), v.as_of)


@query
def contracts_counts(v: Standin) -> DataFrame:
    return contracts.count_by_origin(v.contracts())


@query
def clean_object_text(v: Standin) -> DataFrame:
    return v.contracts().select(
        "numero_contrato",
        "cnpj_contratado",
        text.clean_object_text(F.col("objeto")).alias("objeto_limpo"),
    )


@query
def status_label(v: Standin) -> DataFrame:
    return v.establishments().select(
        "cnpj", text.status_label(F.col("situacao_cadastral")).alias("situacao")
    )


# universe


@query
def universe_base(v: Standin) -> DataFrame:
    return register.universe_base(v.sanctions(), v.contracts())


@query
def universe_neighbors(v: Standin) -> DataFrame:
    return register.universe_neighbors(v.sanctions(), v.partners())


@query
def universe(v: Standin) -> DataFrame:
    return register.universe(v.sanctions(), v.contracts(), v.partners())


@query
def partners_in_universe(v: Standin) -> DataFrame:
    return register.restrict(v.build_partners(), v.late_universe())


@query
def companies_in_universe(v: Standin) -> DataFrame:
    return register.restrict(v.build_companies(), v.late_universe())


@query
def establishments_in_universe(v: Standin) -> DataFrame:
    return register.restrict(v.build_establishments(), v.late_universe())


@query
def companies_of_neighbors(v: Standin) -> DataFrame:
    return register.restrict(v.companies(), universe_neighbors(v))


# links and risk


@query
def links_high(v: Standin) -> DataFrame:
    return links.high_links(v.held())


@query
def hyperconnectors(v: Standin) -> DataFrame:
    return links.hyperconnectors(v.held(), v.limit)


@query
def links_medium(v: Standin) -> DataFrame:
    return links.medium_links(v.held(), v.limit)


def _all_links(v: Standin) -> DataFrame:
    return links.links(v.held(), v.limit)


REGISTRY["links"] = lambda spark, folder: comparable(_all_links(Standin(spark, folder)))


@query
def links_counts(v: Standin) -> DataFrame:
    return links.count_links(_all_links(v))


@query
def links_counts_grouped(v: Standin) -> DataFrame:
    return links.count_links_grouped(v.held(), v.limit)


@query
def risk_degree0(v: Standin) -> DataFrame:
    return risk.degree0(v.sanctions())


@query
def risk_edges(v: Standin) -> DataFrame:
    return risk.risk_edges(v.held(), v.sanctioned(), v.limit)


@query
def successor_signal(v: Standin) -> DataFrame:
    return risk.with_successor_signal(risk_edges(v), v.sanctioned(), v.establishments())


@query
def risk_degrees(v: Standin) -> DataFrame:
    return v.build_risk()


@query
def company_risk(v: Standin) -> DataFrame:
    return v.build_company_risk()


@query
def risk_degree2(v: Standin) -> DataFrame:
    """Degree 2 as seen from the companies with a leniency agreement in force."""
    agreements = risk.degree0(v.sanctions().filter(F.col("fonte") == "LENIENCIA"))
    return risk.degree2(v.held(), v.sanctions(), agreements, v.as_of, years=2, limit=v.limit)


@query
def risk_counts(v: Standin) -> DataFrame:
    return risk.count_company_risk(v.company_risk())


@query
def successor_candidates(v: Standin) -> DataFrame:
    return candidates.successor_candidates(
        v.risk(), v.sanctions(), v.contracts(), v.establishments(), v.names(), v.as_of
    )


# reports


@query
def radar_summary(v: Standin) -> DataFrame:
    return reports.radar_summary(v.contracts(), v.sanctioned(), v.as_of)


@query
def statistics(v: Standin) -> DataFrame:
    return reports.statistics(v.contracts(), v.sanctioned(), v.company_risk(), v.as_of)


@query
def agencies_ranking(v: Standin) -> DataFrame:
    return reports.agencies_ranking(v.contracts(), v.sanctioned())


def _suppliers(v: Standin) -> DataFrame:
    return reports.supplier_totals(v.contracts(), v.company_risk(), v.as_of)


@query
def agency_suppliers(v: Standin) -> DataFrame:
    return reports.agency_suppliers(_suppliers(v))


@query
def agency_suppliers_by_degree(v: Standin) -> DataFrame:
    return reports.agency_suppliers(_suppliers(v), degree=0)


@query
def agency_header(v: Standin) -> DataFrame:
    return reports.agency_header(v.contracts(), _suppliers(v))


# companies


@query
def best_name(v: Standin) -> DataFrame:
    return companies.best_name(v.names())


def _search(v: Standin, typed: str) -> DataFrame:
    return companies.search(v.names(), v.establishments(), v.company_risk(), typed)


@query
def company_search_name(v: Standin) -> DataFrame:
    return _search(v, "tômer#%9_")


@query
def company_search_root(v: Standin) -> DataFrame:
    return _search(v, "00.000.011/0001-00")


# wildcards, accents, parts shorter than a gram, a root, everything, nothing
SEARCHES = ["tômer#%9_", "customer#%012", "11", "c cust%1_", "r#0%0", "não há", "00.000.011/0001-00", "%"]


@query
def company_search_indexed(v: Standin) -> DataFrame:
    index, found = v.name_index(), None
    for typed in SEARCHES:
        rows = index.search(typed, v.establishments(), v.company_risk())
        rows = rows.select(F.lit(typed).alias("consulta"), "*")
        found = rows if found is None else found.unionByName(rows)
    return found


@query
def company_sheet_pruned(v: Standin) -> DataFrame:
    return v.clustered().sheet(v.as_of)


def _known(v: Standin) -> DataFrame:
    return companies.known_roots(v.names(), v.partners(), v.company_risk())


@query
def company_badge(v: Standin) -> DataFrame:
    return companies.badge(_known(v), v.company_risk())


@query
def company_sheet_known(v: Standin) -> DataFrame:
    return _known(v)


@query
def company_sheet_registration(v: Standin) -> DataFrame:
    return companies.sheet_registration(v.companies(), v.establishments(), v.names(), _known(v))


@query
def company_sheet_risk(v: Standin) -> DataFrame:
    return companies.sheet_risk(v.risk())


@query
def company_sheet_sanctions(v: Standin) -> DataFrame:
    return companies.sheet_sanctions(v.sanctions())


@query
def company_sheet_contracts(v: Standin) -> DataFrame:
    return companies.sheet_contracts(v.contracts())


@query
def company_sheet_partners(v: Standin) -> DataFrame:
    return companies.sheet_partners(v.partners())


@query
def audit_sheet(v: Standin) -> DataFrame:
    return companies.audit_sheet(
        v.sanctions(), v.contracts(), v.partners(), v.company_risk(), v.as_of
    )


# graph


@query
def graph_depth1_edges(v: Standin) -> DataFrame:
    return graph.depth1_edges(v.held(), v.centres(), v.limit)


@query
def graph_depth2_edges(v: Standin) -> DataFrame:
    return graph.depth2_edges(v.held(), v.centres(), v.limit)


def _neighbourhood(v: Standin) -> graph.Neighbourhood:
    return graph.neighbourhood(v.held(), v.centres(), v.limit)


@query
def graph_depth2_shared(v: Standin) -> DataFrame:
    return _neighbourhood(v).joined()


@query
def graph_nodes(v: Standin) -> DataFrame:
    return _neighbourhood(v).nodes(v.names(), v.company_risk())


@query
def graph_edge_bundles(v: Standin) -> DataFrame:
    return graph.edge_bundles(v.stored("grafo1", lambda: graph_depth1_edges(v)))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


__all__ = ["queries"]
