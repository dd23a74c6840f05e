from __future__ import annotations

import json
import subprocess
import sys
import zipfile
from datetime import date
from pathlib import Path

import pytest

from contraluz.functions.charset import repair_bytes, repair_header, repair_record
from contraluz.plans import contracts
from contraluz.sources import delimited, json_pages, landing
from contraluz.sources.archives import zip_headerless, zip_records, zip_with_header


# bytes of a field or record and the text they stand for
CASES = [
    (b"", ""),
    (b"no accents", "no accents"),
    (b"p\xc3\xa3o", "pão"),
    (b"p\xe3o", "pão"),
    (b"10 \x80", "10 €"),
    (b"\x8d\xe3", "\x8dã"),
    (b"p\xc3\xa3o\np\xe3o\n", "pão\npão\n"),
]


def test_charset_repair(scalar):
    single = [c for c in CASES if b"\n" not in c[0]]
    for repair, cases in ((repair_bytes, single), (repair_record, CASES)):
        got = scalar(repair, [bytearray(raw) for raw, _ in cases], "binary")
        assert got == [text for _, text in cases]


def test_header_repair():
    raw = "RAZÃO SOCIAL – CADASTRO RECEITA;SITUAÇÃO".encode("cp1252").decode("latin-1")
    assert repair_header(raw.split(";")) == ["RAZÃO SOCIAL - CADASTRO RECEITA", "SITUAÇÃO"]
    assert repair_header(["A B", "C\u0096D"]) == ["A B", "C-D"]


def test_header_files_with_quotes_newlines_and_mixed_charset(spark, tmp_path):
    body = b'"A";"RAZ\xc3O \x96 B"\r\n"1";"x ""y"" z"\r\n"2";"linha 1\nlinha \xe7"\r\n"3";""\r\n'
    (tmp_path / "202503_Compras.csv").write_bytes(body)
    got = delimited.with_period(delimited.read_with_header(spark, str(tmp_path)))
    rows = {r["A"]: (r["RAZÃO - B"], r["competencia"]) for r in got.collect()}
    assert rows == {
        "1": ('x "y" z', "202503"), "2": ("linha 1\nlinha ç", "202503"), "3": (None, "202503"),
    }


def test_headerless_files(spark, tmp_path):
    (tmp_path / "a").write_bytes('"1";"ação";""\r\n'.encode("latin-1") + '"2";"ação";"x"\n'.encode())
    got = delimited.read_headerless(spark, str(tmp_path), ["a", "b", "c"])
    assert sorted(map(tuple, got.collect())) == [("1", "ação", None), ("2", "ação", "x")]


@pytest.mark.parametrize("multiline", [True, False])
def test_headerless_files_with_a_byte_order_mark(spark, tmp_path, multiline):
    (tmp_path / "a").write_bytes(b'\xef\xbb\xbf"1";"x"\n"2";"y"\n')
    got = delimited.read_headerless(spark, str(tmp_path), ["a", "b"], multiline)
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", "y")]


def test_plain_and_zipped_files_join_broken_records_alike(spark, tmp_path):
    body = b'"1";"one\ntwo"\n"2";"three"\n'
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a").write_bytes(body)
    path = make_zip(tmp_path / "a.zip", {"m": body})
    plain = delimited.read_headerless(spark, str(tmp_path / "plain"), ["a", "b"])
    want = [("1", "one\ntwo"), ("2", "three")]
    assert sorted(map(tuple, plain.collect())) == want
    assert sorted(map(tuple, zip_headerless(spark, [path], ["a", "b"]).collect())) == want


@pytest.mark.parametrize("body", [b'"1";"x";"y"\n', b'"1"\n'])
def test_ragged_records_fail(spark, tmp_path, body):
    (tmp_path / "bare").write_bytes(body)
    (tmp_path / "head").write_bytes(b'"A";"B"\n' + body)
    path = make_zip(tmp_path / "z.zip", {"m": body})
    for read in (
        lambda: delimited.read_headerless(spark, str(tmp_path / "bare"), ["a", "b"]),
        lambda: delimited.read_headerless(spark, str(tmp_path / "bare"), ["a", "b"], False),
        lambda: delimited.read_with_header(spark, str(tmp_path / "head")),
        lambda: zip_headerless(spark, [path], ["a", "b"]),
    ):
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            read().collect()


def test_header_orders_must_agree(spark, tmp_path):
    (tmp_path / "1.csv").write_bytes(b'"A";"B"\n"a";"b"\n')
    (tmp_path / "2.csv").write_bytes(b'"B";"A"\n"b";"a"\n')
    with pytest.raises(Exception, match="header|HEADER"):
        delimited.read_with_header(spark, str(tmp_path)).collect()


def test_headers_with_a_byte_order_mark_and_a_quoted_separator(spark, tmp_path):
    body = b'\xef\xbb\xbf"A";"B;C"\n"1";"2"\n'
    (tmp_path / "plain.csv").write_bytes(body)
    path = make_zip(tmp_path / "z.zip", {"m": body})
    for got in (
        delimited.read_with_header(spark, str(tmp_path / "plain.csv")),
        zip_with_header(spark, [path]),
    ):
        assert got.columns == ["A", "B;C", "_arquivo"]
        assert [tuple(r)[:2] for r in got.collect()] == [("1", "2")]


def make_zip(path, members: dict[str, bytes]):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return str(path)


def test_zip_members(spark, tmp_path):
    head = '"A";"B"\r\n'.encode()
    one = make_zip(tmp_path / "1.zip", {
        "202501_Compras.csv": head + b'"1";"quoted\nline"\r\n"2";"\xe7"',
        "202501_ItemCompra.csv": b'"other"\r\n"9"',
    })
    two = make_zip(tmp_path / "2.zip", {"202502_Compras.csv": head + '"3";"ç"\n'.encode()})
    got = delimited.with_period(zip_with_header(spark, [one, two], "_compras.csv"))
    rows = sorted((r["A"], r["B"], r["competencia"]) for r in got.collect())
    assert rows == [("1", "quoted\nline", "202501"), ("2", "ç", "202501"), ("3", "ç", "202502")]
    assert zip_records(spark, [one, two]).count() == 7
    assert got.rdd.getNumPartitions() == 2
    bare = zip_headerless(spark, [two], ["x", "y"])
    assert bare.count() == 2


def test_workers_need_no_package(tmp_path):
    """Run from a folder where Python workers cannot import this package."""
    path = make_zip(tmp_path / "a.zip", {"m.csv": b'"1"\n"2"'})
    root = Path(__file__).resolve().parents[1]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from contraluz.session import build_session
from contraluz.sources.archives import zip_headerless
spark = build_session(**{{"spark.master": "local[2]", "spark.ui.enabled": "false"}})
print("rows", zip_headerless(spark, [{path!r}], ["a"]).count())
"""
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_zip_headers_must_agree(spark, tmp_path):
    a = make_zip(tmp_path / "a.zip", {"m.csv": b'"A"\n"1"'})
    b = make_zip(tmp_path / "b.zip", {"m.csv": b'"B"\n"1"'})
    with pytest.raises(ValueError, match="header"):
        zip_with_header(spark, [a, b], "m.csv")


def test_unbalanced_quote_fails(spark, tmp_path):
    a = make_zip(tmp_path / "a.zip", {"m.csv": b'"A"\n"1\n'})
    with pytest.raises(Exception, match="unbalanced quote"):
        zip_headerless(spark, [a], ["a"]).collect()


def test_latest_snapshot(spark, tmp_path):
    for name in ("20260101_ceis.zip", "20260301_ceis.zip", "20260201_cnep.zip"):
        make_zip(tmp_path / name, {"x.csv": b"x"})
    files = landing.list_files(spark, str(tmp_path), "*.zip")
    paths = landing.latest_paths(files, ["ceis", "cnep"])
    assert paths["ceis"].endswith("20260301_ceis.zip")
    with pytest.raises(FileNotFoundError, match="cepim"):
        landing.latest_paths(files, ["ceis", "cepim"])


def test_old_copies_in_other_folders_hide_no_snapshot(spark, tmp_path):
    for name in ("new/20260301_ceis.zip", "old/20260301_ceis.zip", "new/20260301_cnep.zip"):
        make_zip(tmp_path / name, {"x.csv": b"x"})
    paths = landing.latest_paths(landing.list_files(spark, str(tmp_path), "*.zip"), ["ceis", "cnep"])
    assert set(paths) == {"ceis", "cnep"}


def test_months(spark):
    months = landing.month_range(spark, "2025-11", date(2026, 2, 15))
    assert [r[0] for r in months.select("competencia").collect()] == [
        "202511", "202512", "202601", "202602",
    ]
    assert landing.month_range(spark, "2026-03", date(2026, 2, 15)).count() == 0
    for bad in ("2025-13", "25-01", "202501", "2025-00"):
        with pytest.raises(ValueError):
            landing.check_month(bad)


def test_refresh_plan(spark):
    files = spark.createDataFrame(
        [("202511_compras.zip",), ("202601_compras.zip",)], "arquivo string"
    )
    plan = landing.refresh_plan(spark, files, "2025-11", date(2026, 2, 15))
    assert dict(map(tuple, plan.collect())) == {
        "202511": "reaproveitar", "202512": "baixar", "202601": "recarregar", "202602": "baixar",
    }


def test_refresh_replaces_only_its_months(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", "202501"), ("b", "202502")], "v string, competencia string")
    landing.refresh_months(old, path)
    landing.refresh_months(spark.createDataFrame([("c", "202502")], old.schema), path)
    got = spark.read.schema(old.schema).parquet(path)
    assert sorted(map(tuple, got.collect())) == [("a", "202501"), ("c", "202502")]


def contract_record(number, sphere, unit=None, **values):
    """A record with the fields a test is about; all others are absent."""
    return {
        "numeroControlePNCP": number,
        "orgaoEntidade": {"cnpj": "40000000000404", "razaoSocial": "Fundo", "esferaId": sphere},
        "unidadeOrgao": unit,
        **values,
    }


def test_contract_pages(spark, tmp_path):
    city = {"codigoUnidade": "9", "ufSigla": "TO", "codigoIbge": "1721000"}
    pages = {
        "a": [contract_record("m-1", "M", city, niFornecedor="40.000.001/0001-01",
                              nomeRazaoSocialFornecedor="Móveis Ipê", valorGlobal=7654321098765.25)],
        "b": [contract_record("e-1", "E", tipoContrato=None), contract_record("f-1", "F", city)],
        "c": [],
    }
    folder = tmp_path / "competencia=202409"
    folder.mkdir()
    for name, data in pages.items():
        (folder / f"{name}.json").write_text(json.dumps({"data": data, "totalPaginas": 3}, indent=2))
    (folder / "d.json").write_text("")
    records = json_pages.read_contract_pages(spark, str(tmp_path), multiline=True)
    both = contracts.contracts_table(["E", "M"], records=records)
    assert sorted((r["numero_contrato"], r["uf"]) for r in both.collect()) == [("e-1", None), ("m-1", "TO")]
    row = contracts.contracts_table(["M"], records=records, state="TO").first()
    assert (row["competencia"], row["cnpj_contratado"]) == ("202409", "40000001000101")
    assert row["nome_contratado_normalizado"] == "MOVEIS IPE"
    assert str(row["valor_final"]) == "7654321098765.25"
    assert contracts.contracts_table(["M"], records=records, city_code="2").isEmpty()
    with pytest.raises(ValueError, match="spheres"):
        contracts.in_scope(records, ["X"])


def test_modalities(spark, tmp_path):
    folder = tmp_path / "competencia=202606"
    folder.mkdir()
    data = [{"numeroControlePNCP": str(i), "modalidadeId": i, "objetoCompra": "x"} for i in (6, 8, 99)]
    (folder / "1.json").write_text(json.dumps({"data": data, "totalPaginas": 1}))
    got = json_pages.read_procurement_pages(spark, str(tmp_path))
    assert {r["modalidade_id"]: r["modalidade"] for r in got.collect()} == {
        6: "Pregão - Eletrônico", 8: "Dispensa", 99: None,
    }
    assert json_pages.read_procurement_pages(spark, str(tmp_path), [8]).count() == 1
    with pytest.raises(ValueError, match="modalities"):
        json_pages.read_procurement_pages(spark, str(tmp_path), [77])
