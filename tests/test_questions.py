"""The question set on hand-made tables."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from contraluz import schemas
from contraluz.plans import candidates, companies, graph, links, reports, risk

# barred, opened later with the same partners, register only, contracts only, partners only
ZERO, HEIR, CLEAN, ONLY, BARE = (f"5000000{n}" for n in range(1, 6))


class World:
    """Five companies, each of them known to other tables than the rest."""

    def __init__(self, spark):
        self.spark, self.as_of = spark, date(2024, 7, 1)

        def table(schema, columns, *rows):
            """Rows of the given columns; all others of the schema are null."""
            given = columns.split()
            full = [dict(zip(given, row, strict=True)) for row in rows]
            return spark.createDataFrame(
                [tuple(row.get(name) for name in schema.fieldNames()) for row in full], schema
            )

        self.companies = table(
            schemas.COMPANIES, "cnpj_basico razao_social porte",
            (ZERO, "CERÂMICA SÃO TOMÉ", "01"), (HEIR, "TOMÉ REVESTIMENTOS", "05"), (CLEAN, "FARO", None),
        )
        self.offices = table(
            schemas.ESTABLISHMENTS,
            "cnpj_basico cnpj matriz_filial situacao_cadastral data_inicio_atividade cnae_principal uf "
            "municipio_codigo",
            (ZERO, ZERO + "000101", "1", "02", date(1999, 9, 9), "2342", "CE", "1389"),
            (HEIR, HEIR + "000102", "1", "02", date(2021, 3, 3), "2342", "CE", "1389"),
            (CLEAN, CLEAN + "000203", "2", "08", date(2005, 5, 5), "9001", "PA", "427"),
        )
        self.sanctions = table(
            schemas.SANCTIONS, "processo cnpj_cpf nome fonte categoria data_inicio vigente",
            ("2020/7", ZERO + "000101", "CERAMICA S TOME", "CNEP", "Declaração de inidoneidade",
             date(2020, 7, 7), True),
            # a person whose id starts like a company root
            ("2021/8", CLEAN + "888", "UMA PESSOA", "CEIS", "Multa", None, True),
        )
        self.contracts = table(
            schemas.CONTRACTS,
            "numero_contrato orgao_codigo orgao cnpj_contratado nome_contratado valor_final "
            "data_fim_vigencia objeto",
            ("X/10", "11", "Porto", ZERO + "000101", "CERAMICA TOME", Decimal(40000), date(2025, 5, 5),
             "OBJETO: Telhas"),
            ("X/11", "11", "Porto", HEIR + "000102", "REVESTIMENTOS", Decimal(300), None, None),
            ("X/12", "11", "Porto", ZERO + "777", "OUTRA PESSOA", Decimal(2), date(2025, 5, 5), None),
            ("Y/13", "22", "Farol", ONLY + "000104", "BARCOS E REDES", Decimal(6000), date(2024, 6, 30),
             None),
        )
        shared = [("BIA NUNES", "***314159**"), ("RUI PAZ", "***271828**")]
        self.partners = table(
            schemas.PARTNERS, "cnpj_basico nome_socio cpf_mascarado",
            *[(company, *person) for company in (ZERO, HEIR) for person in shared],
            (BARE, "EVA LUZ", "***161803**"),
        )
        self.held = links.holdings(self.partners)
        self.zero = risk.degree0(self.sanctions)
        self.risk = risk.risk_degrees(self.held, self.zero, self.offices)
        self.company_risk = risk.company_risk(self.held, self.zero, self.offices)
        self.names = companies.names(self.companies, self.sanctions, self.contracts)

    def roots(self, *values):
        return self.spark.createDataFrame([(v,) for v in values], "cnpj_basico string")


@pytest.fixture(scope="module")
def w(spark):
    return World(spark)


def search(w, typed):
    return companies.search(w.names, w.offices, w.company_risk, typed).collect()


def test_search(w):
    def found(typed):
        return {(r["cnpj_basico"], r["grau"], r["uf"], r["indicio_sucessora"]) for r in search(w, typed)}

    assert found("ceramica sao") == {(ZERO, 0, "CE", False)}
    assert found("50.000.002/0001-02") == {(HEIR, 1, "CE", True)}
    assert found("bar%s e r_des") == {(ONLY, None, None, False)}  # wildcards of the typed text count
    assert found("FARO") == {(CLEAN, None, None, False)}
    assert found("no\\such") == set()
    assert [r["grau"] for r in search(w, "re")] == [1, None]


def test_best_name(w):
    assert {tuple(r)[:2] for r in companies.best_name(w.names).select("cnpj_basico", "nome").collect()} == {
        (ZERO, "CERÂMICA SÃO TOMÉ"), (HEIR, "TOMÉ REVESTIMENTOS"), (CLEAN, "FARO"),
        (ONLY, "BARCOS E REDES"),
    }


def test_sheet(w):
    known = companies.known_roots(w.names, w.partners, w.risk)
    sheet = companies.sheet_registration(w.companies, w.offices, w.names, known)
    rows = {r["cnpj_basico"]: r for r in sheet.collect()}
    assert set(rows) == {ZERO, HEIR, CLEAN, ONLY, BARE}
    assert rows[ZERO]["cadastro_receita_disponivel"] and rows[ZERO]["situacao"] == "Ativa"
    assert rows[CLEAN]["uf"] is None  # a branch is not a head office
    assert rows[ONLY]["razao_social"] == "BARCOS E REDES"
    assert not rows[ONLY]["cadastro_receita_disponivel"]
    assert rows[BARE]["razao_social"] is None
    asked = w.roots(BARE, "99999999")
    assert [r[0] for r in companies.known_roots(w.names, w.partners, w.risk, asked).collect()] == [BARE]

    risks = companies.sheet_risk(w.risk, w.roots(HEIR)).collect()
    assert [(r["grau"], r["relacionada"], r["socio_comum"]) for r in risks] == [
        (1, ZERO, "BIA NUNES"), (1, ZERO, "RUI PAZ"),
    ]
    assert [r["processo"] for r in companies.sheet_sanctions(w.sanctions).collect()] == ["2020/7"]
    assert companies.sheet_sanctions(w.sanctions, w.roots(HEIR)).count() == 0
    contracts = companies.sheet_contracts(w.contracts, w.roots(ZERO)).collect()
    assert [(r["numero_contrato"], r["objeto_limpo"]) for r in contracts] == [("X/10", "Telhas")]
    assert companies.sheet_contracts(w.contracts, limit=1).count() == 3
    partners = companies.sheet_partners(w.partners, w.roots(ZERO)).collect()
    assert [r["nome_socio"] for r in partners] == ["BIA NUNES", "RUI PAZ"]


def test_badge(w):
    known = companies.known_roots(w.names, w.partners, w.risk)
    got = {r[0]: r["selo"] for r in companies.badge(known, w.company_risk).collect()}
    assert got[ZERO] == "Sanção vigente" and "possível sucessora" in got[HEIR]
    assert got[CLEAN] == "Sem alerta nos dados"


def test_agencies(w):
    rows = reports.agencies_ranking(w.contracts, w.zero).collect()
    assert [(r["orgao"], r["contratos"], r["contratos_sob_alerta"]) for r in rows] == [
        ("Porto", 3, 1), ("Farol", 1, 0),
    ]
    assert rows[0]["valor_sob_alerta"] == 40000 and rows[1]["valor_sob_alerta"] == 0


def test_suppliers(w):
    totals = reports.supplier_totals(w.contracts, w.company_risk, w.as_of)
    rows = reports.agency_suppliers(totals).filter("orgao_codigo = '11'").collect()
    got = {(r["cnpj_basico"], r["grau"]): r for r in rows}
    assert set(got) == {(ZERO, 0), (HEIR, 1), (ZERO, None)}  # the person stays apart
    assert got[(ZERO, 0)]["contratos_vigentes"] == 1
    # two degree-1 rows do not double the value
    assert got[(HEIR, 1)]["valor_total"] == 300 and got[(HEIR, 1)]["contratos_vigentes"] == 0
    assert reports.agency_suppliers(totals, degree=0).filter("orgao_codigo = '22'").count() == 0
    head = {r["orgao_codigo"]: r for r in reports.agency_header(w.contracts, totals).collect()}
    assert (head["11"]["fornecedores"], head["11"]["com_alerta"]) == (3, 2)
    assert set(head) == {"11", "22"}


def test_statistics(w):
    (row,) = reports.statistics(w.contracts, w.zero, w.company_risk, w.as_of).collect()
    assert tuple(row) == (1, 1, 1, 1, 1, Decimal("40000.00"))
    nothing = w.contracts.filter("false")
    (empty,) = reports.radar_summary(nothing, w.zero, w.as_of).collect()
    assert tuple(empty) == (0, 0, Decimal(0))


def test_graph(w):
    centres = w.roots(ZERO, CLEAN)
    edges = graph.depth1_edges(w.held, centres)
    assert {tuple(r) for r in edges.collect()} == {
        (ZERO, ZERO, HEIR, "BIA NUNES", "alta"), (ZERO, ZERO, HEIR, "RUI PAZ", "alta"),
    }
    nodes = graph.nodes(edges, centres, w.names, w.company_risk).collect()
    assert {(r["centro"], r["id"], r["grau"]) for r in nodes} == {
        (ZERO, ZERO, 0), (ZERO, HEIR, 1), (CLEAN, CLEAN, None),
    }
    bundles = graph.edge_bundles(edges).collect()
    assert len(bundles) == edges.count() and {(r["socios"], r["confianca"]) for r in bundles} == {(2, "alta")}


@pytest.mark.parametrize("cell", [1, 10_000])
def test_graph_depth_two(spark, cell):
    rows = [("1", "A"), ("2", "A"), ("2", "B"), ("3", "B"), ("3", "C"), ("4", "C"), ("5", "D"),
            ("6", "D"), ("2", "E"), ("4", "E")]
    held = spark.createDataFrame(
        [(r, n, "111111") for r, n in rows], "cnpj_basico string, nome_socio string, doc string"
    )
    centres = spark.createDataFrame([("1",), ("5",)], "cnpj_basico string")
    got = {tuple(r)[:4] for r in graph.depth2_edges(held, centres, cell_rows=cell).collect()}
    # 3-4 joins two second-ring companies and is not part of it
    assert got == {
        ("1", "1", "2", "A"), ("1", "2", "3", "B"), ("1", "2", "4", "E"), ("5", "5", "6", "D"),
    }
    assert {tuple(r)[:4] for r in graph.depth1_edges(held, centres, cell_rows=cell).collect()} < got


@pytest.mark.parametrize("asked,edges", [(-3, 2), (1, 2), (2, 3), (9, 3)])
def test_graph_depth_is_kept_between_one_and_two(spark, asked, edges):
    rows = [("1", "A"), ("2", "A"), ("2", "B"), ("3", "B"), ("1", "C"), ("4", "C")]
    held = spark.createDataFrame(
        [(r, n, "9") for r, n in rows], "cnpj_basico string, nome_socio string, doc string"
    )
    centres = spark.createDataFrame([("1",)], "cnpj_basico string")
    assert graph.graph_edges(held, centres, asked).count() == edges


def test_candidates(w, tmp_path):
    ranked = candidates.successor_candidates(
        w.risk, w.sanctions, w.contracts, w.offices, w.names, w.as_of
    )
    candidates.export_candidates(ranked, str(tmp_path / "csv"))
    assert w.spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    rows = ranked.collect()
    assert [(r["cnpj_basico"], r["socio_comum"], r["forca"]) for r in rows] == [
        (HEIR, "BIA NUNES", 7), (HEIR, "RUI PAZ", 7),
    ]
    assert rows[0]["razao_social_relacionada"] == "CERÂMICA SÃO TOMÉ"


def test_audit(w):
    rows = companies.audit_sheet(w.sanctions, w.contracts, w.partners, w.company_risk, w.as_of)
    got = {r["cnpj_basico"]: r for r in rows.collect()}
    zero = got[ZERO]
    assert (zero["grau"], zero["sancoes"], zero["contratos"], zero["socios"]) == (0, 1, 1, 2)
    assert zero["valor_contratos"] == 40000 and got[BARE]["grau"] is None


def test_invariants(w):
    one = w.risk.filter("grau = 1").select("cnpj_basico").distinct()
    zero = w.risk.filter("grau = 0").select("cnpj_basico")
    assert one.join(zero, "cnpj_basico").count() == 0
    keys = ["cnpj_basico", "relacionada", "socio_comum"]
    assert w.risk.groupBy(*keys).count().filter(F.col("count") > 1).count() == 0
