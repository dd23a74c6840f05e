"""Name index against the scan, tables by root against the audit sheet, links counted from groups."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from contraluz.plans import companies, links
from contraluz.plans.clustered import Clustered
from contraluz.plans.name_index import NameIndex, pattern_grams
from contraluz.tables import TableStore

NAMES = [
    ("00000001", "Padaria São João Ltda", 1), ("00000001", "PADARIA SAO JOAO", 3),
    ("00000002", "Padoaria Sã Jo", 2), ("00000003", "AB", 1), ("00000004", "C", 2),
    ("00000005", "abcabcabc", 1), ("00000006", "cab abc", 1), ("00000007", "50% off_sale\\co", 1),
    ("00000008", "  Água   e  Óleo ", 1), ("00000008", "Água e Óleo", 1), ("00000009", "ABCAB", 1),
    ("00000010", "", 1), ("00000011", "Construtora Ñandú 😀 S/A", 1),
]
TYPED = [
    "padaria", "sao jo", "são joão ltda", "a", "ab", "abc", "abcabc", "bca", "%", "_", "__", "a%o", "p_d", "%abc%c",
    "50%", "\\co", "off_sale", "água e", "agua  e óleo", "ñandu 😀", "zzz", "abz", "", " ", "00000005", "00.000.008/0001-00",
]


@pytest.fixture(scope="module")
def search_tables(spark):
    offices = spark.createDataFrame(
        [(f"{n:08d}", "1", "SP", "02") for n in range(1, 9)],
        "cnpj_basico string, matriz_filial string, uf string, situacao_cadastral string",
    )
    risk = spark.createDataFrame([("00000005", 0, False), ("00000006", 1, True)], "cnpj_basico string, grau int, indicio_sucessora boolean")
    return spark.createDataFrame(NAMES, "cnpj_basico string, nome string, prioridade int"), offices, risk


@pytest.fixture(scope="module")
def index(spark, search_tables, tmp_path_factory):
    return NameIndex.build(TableStore(spark, str(tmp_path_factory.mktemp("index"))), search_tables[0])


@pytest.mark.parametrize("typed", TYPED)
def test_index_gives_what_the_scan_gives(index, search_tables, typed):
    names, offices, risk = search_tables
    want = companies.search(names, offices, risk, typed).collect()
    assert index.search(typed, offices, risk).collect() == want
    assert len(index.search(typed, offices, risk, 1).collect()) == min(1, len(want))


def test_grams_of_patterns():
    assert pattern_grams("ABCD%XYZ_AB") == ["ABC", "BCD", "XYZ"] and pattern_grams("AB%CD") == []


def test_postings_are_read_by_gram(index):
    plan = index.candidates("PADARIA")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trigrama" in plan and "nome" not in plan.replace("nomes_", "")


def test_index_of_no_names(spark, search_tables, tmp_path):
    names, offices, risk = search_tables
    empty = NameIndex.build(TableStore(spark, str(tmp_path)), names.limit(0))
    assert [empty.search(t, offices, risk).count() for t in ("abc", "a", "%", "00000001")] == [0] * 4


# layout by root


def _sheet_inputs(spark):
    rng = random.Random(4)
    ids = [f"{n:08d}000100" for n in range(30)] + ["12345678909", None]
    sanctions = spark.createDataFrame(
        [(rng.choice(ids), rng.random() < 0.5) for _ in range(80)], "cnpj_cpf string, vigente boolean"
    )
    contracts = spark.createDataFrame(
        [
            (rng.choice(ids), round(rng.random() * 100, 2) if rng.random() < 0.9 else None,
             date(2025 + n % 3, 1, 1) if n % 5 else None)
            for n in range(200)
        ],
        "cnpj_contratado string, valor_final double, data_fim_vigencia date",
    ).withColumn("valor_final", F.col("valor_final").cast("decimal(18,2)"))
    partners = spark.createDataFrame([(f"{rng.randrange(40):08d}", "x") for _ in range(90)], "cnpj_basico string, nome_socio string")
    risk = spark.createDataFrame([(f"{n:08d}", n % 2) for n in range(0, 50, 3)], "cnpj_basico string, grau int")
    return sanctions, contracts, partners, risk


def test_sheet_by_root_is_the_audit_sheet(spark, tmp_path, as_of):
    inputs = _sheet_inputs(spark)
    tables = Clustered(TableStore(spark, str(tmp_path)), buckets=4).build(*inputs)
    want = companies.audit_sheet(*inputs, as_of)
    sheet = tables.sheet(as_of)
    assert sorted(map(str, sheet.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = sheet._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan

    some = ["00000003", "00000007", "99999999"]
    looked = tables.sheet(as_of, some)
    roots = spark.createDataFrame([(r,) for r in some], "cnpj_basico string")
    wanted = companies.audit_sheet(*inputs, as_of, roots)
    assert sorted(map(str, looked.select(*wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [In(raiz" in plan and "SelectedBucketsCount" in plan

    # another session of the catalog knows nothing of the tables
    for name in ("sancoes", "contratos", "socios", "risco", "raizes"):
        spark.sql(f"DROP TABLE {tables._name(name)}")
    again = Clustered(TableStore(spark, str(tmp_path)), buckets=4).sheet(as_of)
    assert again.count() == want.count()
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()


# links from groups


@pytest.mark.parametrize("limit", [3, 20, None])
def test_links_counted_from_groups(spark, limit):
    rng = random.Random(9)
    rows = {
        (f"{rng.randrange(14):08d}", rng.choice("ABCD"), rng.choice(["", "000000", "1", "2", "3", "4"]))
        for _ in range(220)
    }
    rows |= {("00000099", "E", "1"), ("00000098", "F", ""), ("00000097", "F", "")}
    held = spark.createDataFrame(sorted(rows), "cnpj_basico string, nome_socio string, doc string")
    want = links.count_links(links.links(held, limit)).collect()
    assert links.count_links_grouped(held, limit).collect() == want
    one = held.filter("nome_socio = 'E'")
    assert tuple(links.count_links_grouped(one, limit).first()) == (0, 0)
    assert tuple(links.count_links_grouped(held.limit(0), limit).first()) == (0, 0)
