"""Raw register, sanction and contract files played by the star-schema test tables.

Each method renders whole tables into the official layouts (text dates, Brazilian money, punctuated
ids, duplicates and republished rows), so the jobs run on them exactly as on the real files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contraluz.plans import contracts, links, register, risk, sanctions
from contraluz.plans.clustered import Clustered
from contraluz.plans.companies import names
from contraluz.plans.name_index import COUNTS, NameIndex
from contraluz.schemas import (
    REGISTER_COMPANIES,
    REGISTER_ESTABLISHMENTS,
    REGISTER_PARTNERS,
)
from contraluz.session import scratch_dir
from contraluz.tables import TableStore

AS_OF = date(2000, 1, 1)
LIMIT = 10
SANCTIONED_SINCE, CONTRACTED_SINCE = "200107", "200110"

# Official headers.
CEIS_HEADER = [
    "CADASTRO", "CÓDIGO DA SANÇÃO", "TIPO DE PESSOA", "CPF OU CNPJ DO SANCIONADO",
    "NOME DO SANCIONADO", "NOME INFORMADO PELO ÓRGÃO SANCIONADOR",
    "RAZÃO SOCIAL - CADASTRO RECEITA", "NOME FANTASIA - CADASTRO RECEITA", "NÚMERO DO PROCESSO",
    "CATEGORIA DA SANÇÃO", "DATA INÍCIO SANÇÃO", "DATA FINAL SANÇÃO", "DATA PUBLICAÇÃO",
    "PUBLICAÇÃO", "DETALHAMENTO DO MEIO DE PUBLICAÇÃO", "DATA DO TRÂNSITO EM JULGADO",
    "ABRAGÊNCIA DA SANÇÃO", "ÓRGÃO SANCIONADOR", "UF ÓRGÃO SANCIONADOR",
    "ESFERA ÓRGÃO SANCIONADOR", "FUNDAMENTAÇÃO LEGAL", "DATA ORIGEM INFORMAÇÃO",
    "ORIGEM INFORMAÇÕES", "OBSERVAÇÕES",
]
CNEP_HEADER = [*CEIS_HEADER[:10], "VALOR DA MULTA", *CEIS_HEADER[10:]]
CEPIM_HEADER = [
    "CNPJ ENTIDADE", "NOME ENTIDADE", "NÚMERO CONVÊNIO", "ÓRGÃO CONCEDENTE",
    "MOTIVO DO IMPEDIMENTO",
]
LENIENCY_HEADER = [
    "ID DO ACORDO", "CNPJ DO SANCIONADO", "RAZÃO SOCIAL - CADASTRO RECEITA",
    "NOME FANTASIA - CADASTRO RECEITA", "DATA DE INÍCIO DO ACORDO", "DATA DE FIM DO ACORDO",
    "SITUAÇÃO DO ACORDO DE LENIÊNICA", "DATA DA INFORMAÇÃO", "NÚMERO DO PROCESSO",
    "TERMOS DO ACORDO", "ÓRGÃO SANCIONADOR",
]
PURCHASE_HEADER = [
    "Número do Contrato", "Objeto", "Fundamento Legal", "Modalidade Compra", "Situação Contrato",
    "Código Órgão Superior", "Nome Órgão Superior", "Código Órgão", "Nome Órgão", "Código UG",
    "Nome UG", "Data Assinatura Contrato", "Data Publicação DOU", "Data Início Vigência",
    "Data Fim Vigência", "Código Contratado", "Nome Contratado", "Valor Inicial Compra",
    "Valor Final Compra", "Número Licitação", "Código UG Licitação", "Nome UG Licitação",
    "Código Modalidade Compra Licitação", "Modalidade Compra Licitação",
]

CEIS_CATEGORY = {
    "AUTOMOBILE": "Declaração de Inidoneidade sem prazo",
    "BUILDING": "Suspensão",
    "FURNITURE": "Impedimento/proibição de contratar",
    "HOUSEHOLD": "Proibição de convênio",
    "MACHINERY": "DECLARAÇÃO DE INIDONEIDADE",
}
MODALITY = {"A": "Pregão", "N": "Dispensa de Licitação", "R": "Concorrência"}
STATUS = ["01", "02", "03", "04", "08", "99"]


def root_of(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 8, "0")


def punctuated(company_id: Column) -> Column:
    """14 digits as 00.000.000/0000-00, 11 digits as 000.000.000-00."""
    company = F.regexp_replace(
        company_id, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"
    )
    return F.regexp_replace(company, r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")


def money(amount: Column) -> Column:
    return amount.cast("decimal(18,2)")


def money_text(amount: Column) -> Column:
    return F.translate(F.format_number(money(amount), 2), ",.", ".,")


def date_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def _choose(column: Column, values: dict[str, str]) -> Column:
    chain = F
    for key, value in values.items():
        chain = chain.when(column == key, F.lit(value))
    return chain.otherwise(F.lit(None).cast("string"))


def _in_layout(df: DataFrame, header: list[str], values: dict[str, Column]) -> DataFrame:
    missing = F.lit(None).cast("string")
    return df.select(*[values.get(name, missing).cast("string").alias(name) for name in header])


@dataclass(frozen=True)
class Standin:
    """Stand-in inputs over one folder of test tables, and the tables the jobs build from them."""

    spark: SparkSession
    folder: str
    as_of: date = AS_OF
    limit: int = LIMIT

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table over all cores: a test file is one row group, which a single task would render."""
        return self.table(name).repartition(self.spark.sparkContext.defaultParallelism)

    # renderings of the raw files

    def _sanction_orders(self, source: str) -> DataFrame:
        """The orders of a register: every order is in one of the four.

        Urgent orders, and some of high priority, of customers in debt are sanctions of companies;
        all others are sanctions of persons, with 11-digit ids.
        """
        status, high = F.col("o_orderstatus"), F.col("o_orderpriority") == "2-HIGH"
        register = (
            F.when(status == "P", "CNEP")
            .when(status == "O", "CEPIM")
            .otherwise(F.when(high, "LENIENCIA").otherwise("CEIS"))
        )
        key = F.col("o_orderkey")
        company = (
            (F.col("c_acctbal") < 0)
            & ((F.col("o_orderpriority") == "1-URGENT") | (high & (key % 5 == 0)))
            & (key % 13 != 0)
        )
        person = F.lpad(F.col("c_custkey").cast("string"), 11, "0")
        return (
            self.table("orders")
            .filter(register == source)
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("dia", F.col("o_orderdate").cast("date"))
            .withColumn(
                "cnpj",
                F.when(company, F.concat(root_of("c_custkey"), F.lit("000100"))).otherwise(person),
            )
        )

    def _ceis_values(self, days: int) -> dict[str, Column]:
        name = F.concat(F.lit("S "), "c_name")
        blank = F.col("o_orderkey") % 3 == 0
        sphere = F.element_at(
            F.array(F.lit("FEDERAL"), F.lit("ESTADUAL"), F.lit("MUNICIPAL")),
            (F.col("c_custkey") % 3 + 1).cast("int"),
        )
        return {
            "TIPO DE PESSOA": F.lit("Jurídica"),
            "CPF OU CNPJ DO SANCIONADO": punctuated(F.col("cnpj")),
            "NOME DO SANCIONADO": name,
            "RAZÃO SOCIAL - CADASTRO RECEITA": F.when(blank, F.lit("  ")).otherwise(name),
            "NÚMERO DO PROCESSO": F.col("o_orderkey"),
            "DATA INÍCIO SANÇÃO": date_text(F.col("dia")),
            "DATA FINAL SANÇÃO": date_text(F.date_add("dia", days)),
            "ÓRGÃO SANCIONADOR": F.concat(F.lit("Órgão "), "c_nationkey"),
            "UF ÓRGÃO SANCIONADOR": F.concat(F.lit("U"), "c_nationkey"),
            "ESFERA ÓRGÃO SANCIONADOR": sphere,
            "FUNDAMENTAÇÃO LEGAL": F.lit("Lei"),
        }

    def render_ceis(self) -> DataFrame:
        """Includes exact duplicates."""
        copies = F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
            F.array(F.lit(1))
        )
        rows = self._sanction_orders("CEIS").withColumn("copia", F.explode(copies))
        values = self._ceis_values(365)
        values["CATEGORIA DA SANÇÃO"] = _choose(F.col("c_mktsegment"), CEIS_CATEGORY)
        return _in_layout(rows, CEIS_HEADER, values)

    def render_cnep(self) -> DataFrame:
        category = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Multa")).otherwise(
            F.lit("Publicação extraordinária da decisão condenatória")
        )
        values = self._ceis_values(3650)
        values["CATEGORIA DA SANÇÃO"] = category
        values["VALOR DA MULTA"] = money_text(F.col("o_totalprice"))
        return _in_layout(self._sanction_orders("CNEP"), CNEP_HEADER, values)

    def render_cepim(self) -> DataFrame:
        return _in_layout(
            self._sanction_orders("CEPIM"),
            CEPIM_HEADER,
            {
                "CNPJ ENTIDADE": punctuated(F.col("cnpj")),
                "NOME ENTIDADE": F.concat(F.lit("S "), "c_name"),
                "NÚMERO CONVÊNIO": F.col("o_orderkey"),
                "ÓRGÃO CONCEDENTE": F.concat(F.lit("Órgão "), "c_nationkey"),
                "MOTIVO DO IMPEDIMENTO": F.lit("Prestação de contas"),
            },
        )

    def render_leniency(self) -> DataFrame:
        rows = self._sanction_orders("LENIENCIA")
        return _in_layout(
            rows,
            LENIENCY_HEADER,
            {
                "ID DO ACORDO": F.col("o_orderkey"),
                "CNPJ DO SANCIONADO": punctuated(F.col("cnpj")),
                "NOME FANTASIA - CADASTRO RECEITA": F.concat(F.lit("S "), "c_name"),
                "DATA DE INÍCIO DO ACORDO": date_text(F.col("dia")),
                "DATA DE FIM DO ACORDO": date_text(F.date_add("dia", 1825)),
                "SITUAÇÃO DO ACORDO DE LENIÊNICA": F.lit("F"),
                "NÚMERO DO PROCESSO": F.col("o_orderkey"),
                "TERMOS DO ACORDO": F.lit("Termos"),
                "ÓRGÃO SANCIONADOR": F.concat(F.lit("Órgão "), "c_nationkey"),
            },
        )

    def render_purchases(self) -> DataFrame:
        """Line items as published contracts; repeated line numbers are republished contracts."""
        rows = (
            self.spread("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumn("dia", F.col("l_shipdate").cast("date"))
        )
        person = F.col("o_orderkey") % 97 == 0
        supplier_id = F.when(person, F.lpad(F.col("o_custkey").cast("string"), 11, "0")).otherwise(
            F.concat(root_of("o_custkey"), F.lit("000100"))
        )
        item = F.concat(
            F.lit("Aquisição "), "l_partkey", F.lit(" x "), F.col("l_quantity").cast("int")
        )
        label = (
            F.when(F.col("l_linenumber") == 1, F.concat(F.lit("OBJETO:  "), item))
            .when(F.col("l_linenumber") == 2, F.concat(F.lit("???? "), item))
            .when(F.col("l_linenumber") == 3, F.lit("Objeto: ??"))
            .otherwise(item)
        )
        price = F.col("l_extendedprice")
        layout = _in_layout(
            rows.withColumn("competencia", F.date_format("dia", "yyyyMM")),
            [*PURCHASE_HEADER, "competencia"],
            {
                "competencia": F.col("competencia"),
                "Número do Contrato": F.concat(
                    F.lit("C"), "l_orderkey", F.lit("-"), "l_linenumber"
                ),
                "Objeto": label,
                "Modalidade Compra": _choose(F.col("l_returnflag"), MODALITY),
                "Situação Contrato": F.col("l_linestatus"),
                "Nome Órgão Superior": F.concat(F.lit("Superior "), "s_nationkey"),
                "Código Órgão": F.col("l_suppkey"),
                "Nome Órgão": F.col("s_name"),
                "Código UG": F.lit("110001"),
                "Nome UG": F.lit("Unidade Central"),
                "Data Assinatura Contrato": date_text(F.date_sub("dia", 10)),
                "Data Início Vigência": date_text(F.col("dia")),
                "Data Fim Vigência": date_text(F.date_add("dia", 730)),
                "Código Contratado": punctuated(supplier_id),
                "Nome Contratado": F.when(
                    F.col("c_custkey") % 8 != 0, F.concat(F.lit("C "), "c_name")
                ),
                "Valor Inicial Compra": money_text(money(price) - money(F.col("l_quantity"))),
                "Valor Final Compra": money_text(price),
            },
        )
        return layout

    def render_partners(self) -> DataFrame:
        """Line items as partner rows, accents added to the names.

        A band of the quantity is part of the name, so a name is held by a few companies.
        """
        band = F.floor((F.col("l_quantity") - 1) / 7).cast("string")
        document = (
            F.when(F.col("l_linenumber") == 7, F.lit(""))
            .when(F.col("p_partkey") % 50 == 0, F.lit("***000000**"))
            .otherwise(
                F.concat(F.lit("***"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("**"))
            )
        )
        rows = (
            self.spread("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                "o_custkey",
                F.concat(
                    F.translate("p_name", "ae", "ãé"), F.lit("  "), "p_partkey", F.lit(" "), band
                ).alias("nome"),
                document.alias("doc"),
            )
            .distinct()
        )
        entry = F.date_add(F.lit(date(1995, 1, 1)), (F.col("o_custkey") % 2000).cast("int"))
        return _in_layout(
            rows,
            REGISTER_PARTNERS,
            {
                "cnpj_basico": root_of("o_custkey"),
                "identificador_socio": F.lit("2"),
                "nome_socio": F.col("nome"),
                "cnpj_cpf_socio": F.col("doc"),
                "qualificacao_socio": F.lit("49"),
                "data_entrada": F.date_format(entry, "yyyyMMdd"),
                "representante_legal": F.lit("***000000**"),
                "qualificacao_representante": F.lit("00"),
                "faixa_etaria": F.lit("6"),
            },
        )

    def render_companies(self) -> DataFrame:
        """Every customer but each fourth; the rest exercise the name fallback."""
        return _in_layout(
            self.table("customer").filter("c_custkey % 4 <> 0"),
            REGISTER_COMPANIES,
            {
                "cnpj_basico": root_of("c_custkey"),
                "razao_social": F.col("c_name"),
                "natureza_juridica": F.lit("2062"),
                "qualificacao_responsavel": F.lit("49"),
                "capital_social": F.translate(
                    F.col("c_acctbal").cast("decimal(18,2)").cast("string"), ".", ","
                ),
                "porte": F.lit("03"),
            },
        )

    def render_establishments(self) -> DataFrame:
        """A head office per customer and a branch for every fifth."""
        orders = F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("0001"), F.lit("0002"))).otherwise(
            F.array(F.lit("0001"))
        )
        opened = F.date_add(
            F.lit(date(1995, 1, 1)), (F.col("c_custkey") * 37 % 2400).cast("int")
        )
        status = F.element_at(
            F.array(*[F.lit(s) for s in STATUS]), (F.col("c_nationkey") % 6 + 1).cast("int")
        )
        rows = self.table("customer").withColumn("ordem", F.explode(orders))
        return _in_layout(
            rows,
            REGISTER_ESTABLISHMENTS,
            {
                "cnpj_basico": root_of("c_custkey"),
                "cnpj_ordem": F.col("ordem"),
                "cnpj_dv": F.lit("00"),
                "matriz_filial": F.when(F.col("ordem") == "0001", "1").otherwise("2"),
                "nome_fantasia": F.concat(F.lit("F "), "c_name"),
                "situacao_cadastral": status,
                "data_inicio_atividade": F.date_format(opened, "yyyyMMdd"),
                "cnae_principal": F.col("c_mktsegment"),
                "uf": F.col("c_nationkey"),
                "municipio": F.col("c_nationkey") % 5,
            },
        )

    # the rendered files, written once per session

    def raw_ceis(self) -> DataFrame:
        return self.stored("raw_ceis", self.render_ceis)

    def raw_cnep(self) -> DataFrame:
        return self.stored("raw_cnep", self.render_cnep)

    def raw_cepim(self) -> DataFrame:
        return self.stored("raw_cepim", self.render_cepim)

    def raw_leniency(self) -> DataFrame:
        return self.stored("raw_leniencia", self.render_leniency)

    def raw_purchases(self) -> DataFrame:
        return self.stored("raw_compras", self.render_purchases)

    def raw_partners(self) -> DataFrame:
        return self.stored("raw_socios", self.render_partners)

    def raw_companies(self) -> DataFrame:
        return self.stored("raw_empresas", self.render_companies)

    def raw_establishments(self) -> DataFrame:
        return self.stored("raw_estabelecimentos", self.render_establishments)

    # tables built by the jobs: each stage reads the written tables of the stages before it

    def store(self) -> TableStore:
        """This session's scratch tables."""
        app = self.spark.sparkContext.applicationId
        store = _STORES.get((app, self))
        if store is None:
            store = TableStore(self.spark, scratch_dir(self.spark, "tables"))
            _STORES[(app, self)] = store
        return store

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table as written in this session's scratch folder; built on first use."""
        store = self.store()
        if name not in store.schemas:
            return store.write(name, build())
        return store.read(name)

    def landed(self, name: str, write: Callable[[str], None]) -> str:
        """Folder of stand-in files written once per session; ``write`` gets the folder."""
        key = (self.spark.sparkContext.applicationId, self, name)
        if key not in _LANDED:
            folder = scratch_dir(self.spark, name)
            write(folder)
            _LANDED[key] = folder
        return _LANDED[key]

    def build_sanctions(self) -> DataFrame:
        return sanctions.unify_sanctions(
            self.raw_ceis(), self.raw_cnep(), self.raw_cepim(), self.raw_leniency(), self.as_of
        )

    def sanctions(self) -> DataFrame:
        return self.stored("sancoes", self.build_sanctions)

    def build_contracts(self) -> DataFrame:
        return contracts.contracts_table(["F"], purchases=self.raw_purchases())

    def contracts(self) -> DataFrame:
        return self.stored("contratos", self.build_contracts)

    def build_partners(self) -> DataFrame:
        return register.partners_from_raw(self.raw_partners())

    def partners(self) -> DataFrame:
        return self.stored("socios", self.build_partners)

    def companies(self) -> DataFrame:
        return self.stored("empresas", self.build_companies)

    def build_companies(self) -> DataFrame:
        return register.companies_from_raw(self.raw_companies())

    def build_establishments(self) -> DataFrame:
        return register.establishments_from_raw(self.raw_establishments())

    def establishments(self) -> DataFrame:
        return self.stored("estabelecimentos", self.build_establishments)

    def held(self) -> DataFrame:
        return self.stored("participacoes", lambda: links.holdings(self.partners()))

    def sanctioned(self) -> DataFrame:
        return self.stored("grau0", lambda: risk.degree0(self.sanctions()))

    def build_risk(self) -> DataFrame:
        return risk.risk_degrees(
            self.held(), self.sanctioned(), self.establishments(), self.limit
        )

    def risk(self) -> DataFrame:
        return self.stored("empresas_risco", self.build_risk)

    def build_company_risk(self) -> DataFrame:
        return risk.company_risk(
            self.held(), self.sanctioned(), self.establishments(), self.limit
        )

    def company_risk(self) -> DataFrame:
        return self.stored("risco_por_empresa", self.build_company_risk)

    def universe(self) -> DataFrame:
        return self.stored(
            "universo",
            lambda: register.universe(self.sanctions(), self.contracts(), self.partners()),
        )

    def late_universe(self) -> DataFrame:
        """The universe of what happened since given months, which does not hold every company."""
        late = F.date_format("data_inicio", "yyyyMM") >= SANCTIONED_SINCE
        return self.stored(
            "universo_recente",
            lambda: register.universe(
                self.sanctions().filter(late),
                self.contracts().filter(F.col("competencia") >= CONTRACTED_SINCE),
                self.partners(),
            ),
        )

    def names(self) -> DataFrame:
        return names(self.companies(), self.sanctions(), self.contracts())

    def name_index(self) -> NameIndex:
        """The search index of all names, built on first use."""
        store = self.store()
        return NameIndex(store) if store.exists(COUNTS) else NameIndex.build(store, self.names())

    def clustered(self) -> Clustered:
        """The tables of the company sheet by root, built on first use."""
        tables = Clustered(self.store(), buckets=self.spark.sparkContext.defaultParallelism)
        if not self.store().exists("raizes_por_raiz"):
            tables.build(self.sanctions(), self.contracts(), self.partners(), self.company_risk())
        return tables

    def centres(self) -> DataFrame:
        """Graph centres: companies with a leniency agreement in force."""
        agreements = self.sanctions().filter((F.col("fonte") == "LENIENCIA") & F.col("vigente"))
        return register.sanctioned_roots(agreements)


_STORES: dict[tuple[str, Standin], TableStore] = {}
_LANDED: dict[tuple[str, Standin, str], str] = {}
