"""The full batch, stage by stage: sanctions, contracts, register, links and risk.

Every stage reads files or written tables and writes its own tables; the order follows the
dependencies. Each load returns its row counts as a small DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraluz.plans import contracts, links, register, reload, reports, risk, sanctions
from contraluz.schemas import REGISTER_COMPANIES, REGISTER_ESTABLISHMENTS, REGISTER_PARTNERS
from contraluz.sources import landing, manifest
from contraluz.sources.archives import zip_block_headerless, zip_block_with_header
from contraluz.sources.delimited import with_period
from contraluz.sources.json_pages import read_contract_pages
from contraluz.tables import TableStore

# Base names of the sanction archives and the member that is read from each.
SANCTION_MEMBERS = {
    "ceis": "ceis",
    "cnep": "cnep",
    "cepim": "cepim",
    "acordos-leniencia": "acordos",
}


@dataclass(frozen=True)
class Scope:
    """What to load: spheres, optional state and city, first month."""

    spheres: Sequence[str] = ("F",)
    state: str | None = None
    city_code: str | None = None
    since: str = "2024-01"

    def __post_init__(self) -> None:
        contracts.check_spheres(self.spheres)
        landing.check_month(self.since)


@dataclass(frozen=True)
class Landed:
    """Folders of the landed files; contract pages are needed for spheres E and M only."""

    sanctions: str
    purchases: str
    register: str
    contract_pages: str | None = None


def load_sanctions(store: TableStore, folder: str, as_of: date) -> DataFrame:
    spark = store.spark
    paths = landing.latest_paths(
        landing.list_files(spark, folder, "*.zip"), list(SANCTION_MEMBERS)
    )
    raw = {
        base: zip_block_with_header(spark, [paths[base]], member)
        for base, member in SANCTION_MEMBERS.items()
    }
    table = sanctions.unify_sanctions(
        raw["ceis"], raw["cnep"], raw["cepim"], raw["acordos-leniencia"], as_of
    )
    return sanctions.count_by_source(store.write("sancoes", table))


def purchase_source(store: TableStore, files: DataFrame) -> reload.Source:
    """Monthly purchase archives as a source of published contract rows."""

    def read(paths: list[str]) -> DataFrame:
        raw = with_period(zip_block_with_header(store.spark, paths, "_compras.csv"))
        raw = raw.withColumn("mes_arquivo", manifest.month_of_purchase(F.col("_arquivo")))
        return contracts.from_purchases(raw, keep=["mes_arquivo"])

    month = manifest.month_of_purchase(F.col("arquivo"))
    return reload.Source(manifest.entries(files, reload.PURCHASES, month), read)


def page_source(store: TableStore, folder: str, scope: Scope, as_of: date | None) -> reload.Source:
    """Landed contract pages of the scope's spheres, state and city as a source of contract rows."""
    spheres = [s for s in scope.spheres if s != "F"]

    def read(paths: list[str]) -> DataFrame:
        records = read_contract_pages(store.spark, paths, multiline=True, base=folder)
        kept = contracts.in_scope(records, spheres, scope.state, scope.city_code)
        return contracts.from_json_records(kept)

    month = manifest.month_of_page(F.col("path"))
    files = landing.list_files(store.spark, folder).filter(month >= scope.since.replace("-", ""))
    if as_of is not None:
        files = files.filter(month <= f"{as_of:%Y%m}")
    kept = f"{sorted(spheres)} {scope.state} {scope.city_code}"
    return reload.Source(manifest.entries(files, reload.PAGES, month, kept), read)


def load_contracts(
    store: TableStore, landed: Landed, scope: Scope, as_of: date | None = None
) -> DataFrame:
    """Contracts of the months from ``scope.since`` to that of ``as_of``, if given.

    Months whose files are as in the last run are not read again (``plans.reload``).
    """
    purchases = pages = None
    if "F" in scope.spheres:
        files = landing.list_files(store.spark, landed.purchases, "*_compras.zip")
        purchases = purchase_source(store, landing.purchases_in_range(files, scope.since, as_of))
    if set(scope.spheres) - {"F"}:
        if landed.contract_pages is None:
            raise FileNotFoundError("spheres E and M need contract pages")
        pages = page_source(store, landed.contract_pages, scope, as_of)
    reload.reload_contracts(store, purchases, pages)
    return contracts.count_by_origin(store.read(reload.CONTRACTS))


def load_register(store: TableStore, folder: str, scope: Scope) -> DataFrame:
    spark = store.spark
    newest = landing.latest_folder(landing.list_files(spark, folder, "*.zip"))

    def read(prefix: str, names: list[str]) -> DataFrame:
        pattern = landing.register_part_glob(prefix)
        files = landing.list_files(spark, f"{folder.rstrip('/')}/{newest}", pattern)
        paths = [row["path"] for row in files.select("path").orderBy("path").collect()]
        if not paths:
            raise FileNotFoundError(f"no {prefix} archive in {newest}")
        return zip_block_headerless(spark, paths, names)

    sanctioned, contracted = store.read("sancoes"), store.read("contratos")
    # written once because the universe and the final table both read it
    everyone = store.write(
        "socios_todos", register.partners_from_raw(read("Socios", REGISTER_PARTNERS))
    )
    base = store.write("universo_base", register.universe_base(sanctioned, contracted))
    neighbors = register.universe_neighbors(sanctioned, everyone)
    universe = store.write("universo", base.union(neighbors).distinct())
    tables = {
        "universo_base": base,
        "universo": universe,
        "socios": store.write("socios", register.restrict(everyone, universe)),
        "empresas": store.write(
            "empresas",
            register.restrict(
                register.companies_from_raw(read("Empresas", REGISTER_COMPANIES)), universe
            ),
        ),
        "estabelecimentos": store.write(
            "estabelecimentos",
            register.restrict(
                register.establishments_from_raw(
                    read("Estabelecimentos", REGISTER_ESTABLISHMENTS)
                ),
                universe,
            ),
        ),
    }
    counts = [
        df.agg(F.lit(name).alias("tabela"), F.count(F.lit(1)).alias("registros"))
        for name, df in tables.items()
    ]
    stacked = counts[0]
    for part in counts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def load_links(
    store: TableStore, limit: int = links.HYPERCONNECTOR_LIMIT, pairs: bool = False
) -> DataFrame:
    """Holdings, degrees and risk; links stay factorised as holdings, from which they are counted.

    ``links.links(store.read("participacoes"))`` is the table of all pairs; ``pairs`` writes it.
    """
    held = store.write("participacoes", links.holdings(store.read("socios")))
    if pairs:
        store.write("vinculos", links.links(held, limit))
    sanctioned = store.write("grau0", risk.degree0(store.read("sancoes")))
    offices = store.read("estabelecimentos")
    store.write("empresas_risco", risk.risk_degrees(held, sanctioned, offices, limit))
    per_company = store.write(
        "risco_por_empresa", risk.company_risk(held, sanctioned, offices, limit)
    )
    both = links.count_links_grouped(held, limit).unionByName(
        risk.count_company_risk(per_company), allowMissingColumns=True
    )
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def run(
    spark: SparkSession,
    landed: Landed,
    folder: str,
    as_of: date,
    scope: Scope | None = None,
    limit: int = links.HYPERCONNECTOR_LIMIT,
) -> dict[str, DataFrame]:
    """Run all stages into ``folder``; returns the counts of each stage and the radar summary."""
    scope = scope or Scope()
    store = TableStore(spark, folder)
    counts = {
        "sancoes": load_sanctions(store, landed.sanctions, as_of),
        "contratos": load_contracts(store, landed, scope, as_of),
        "cadastro": load_register(store, landed.register, scope),
        "vinculos": load_links(store, limit),
    }
    counts["radar"] = reports.radar_summary(
        store.read("contratos"), store.read("grau0"), as_of
    )
    return counts
