"""End to end on archives written from typed rows in the published layouts."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from datetime import date
from decimal import Decimal

import pytest

from contraluz import schemas
from contraluz.plans import batch
from catalogue.standin import (
    CEIS_HEADER,
    CEPIM_HEADER,
    CNEP_HEADER,
    LENIENCY_HEADER,
    PURCHASE_HEADER,
)
from contraluz.tables import TableStore


def root(n: int) -> str:
    return f"3{n:07d}"


def written(n: int) -> str:
    """The id of company n as registers write it."""
    digits = root(n)
    return f"{digits[:2]}.{digits[2:5]}.{digits[5:]}/0001-{n:02d}"


class Folder:
    """Archives below one folder, each member a table of dicts."""

    def __init__(self, path):
        self.path = path

    def put(self, archive: str, member: str, columns, rows, charset="latin-1", header=True):
        target = self.path / archive
        target.parent.mkdir(parents=True, exist_ok=True)
        text = io.StringIO(newline="")
        out = csv.DictWriter(text, columns, restval="", delimiter=";", quoting=csv.QUOTE_ALL)
        if header:
            out.writeheader()
        out.writerows(rows)
        with zipfile.ZipFile(target, "a") as z:
            z.writestr(member, text.getvalue().encode(charset))

    def sanctions(self):
        company, name = "CPF OU CNPJ DO SANCIONADO", "RAZÃO SOCIAL - CADASTRO RECEITA"
        process, kind = "NÚMERO DO PROCESSO", "CATEGORIA DA SANÇÃO"
        start, end = "DATA INÍCIO SANÇÃO", "DATA FINAL SANÇÃO"
        open_ended = {
            company: written(1), name: "Usinagem Pão & Mel S/A", process: "A/1", kind: "Suspensão",
            start: "02/02/2023", "UF ÓRGÃO SANCIONADOR": "RS",
        }
        past = {company: written(2), name: "Dois", process: "A/2", start: "10/10/2022", end: "10/10/2024"}
        person = {company: "123.456.789-09", name: "Pessoa", process: "A/3", start: "01/02/2024"}
        self.put("sancoes/20240110_ceis.zip", "ceis.csv", CEIS_HEADER, [{company: written(99)}])
        self.put("sancoes/20240520_ceis.zip", "20240520_CEIS.csv", CEIS_HEADER,
                 [past, open_ended, person, open_ended])
        self.put("sancoes/20240520_cnep.zip", "20240520_CNEP.csv", CNEP_HEADER, [{
            company: written(3), name: "Três", process: "B/1", kind: "Multa",
            "VALOR DA MULTA": "87.000,10", start: "05/05/2022", end: "05/05/2027"}])
        self.put("sancoes/20240520_cepim.zip", "20240520_CEPIM.csv", CEPIM_HEADER, [
            {"CNPJ ENTIDADE": written(n), "NOME ENTIDADE": f"Casa {n}"} for n in (4, 6)])
        dashed = [c.replace(" - ", " – ") for c in LENIENCY_HEADER]
        self.put("sancoes/20240520_acordos-leniencia.zip", "20240520_Acordos.csv", dashed, [{
            "CNPJ DO SANCIONADO": written(5), dashed[2]: "Cinco Irmãs",
            "DATA DE INÍCIO DO ACORDO": "09/09/2023", "DATA DE FIM DO ACORDO": "09/09/2030",
            "SITUAÇÃO DO ACORDO DE LENIÊNICA": "Vigente"}], "cp1252")
        self.put("sancoes/20240520_acordos-leniencia.zip", "20240520_Efeitos.csv", ["X"], [{"X": "1"}])

    def purchases(self):
        def bought(number, supplier, value):
            return {
                "Número do Contrato": number, "Código UG": "77", "Código Órgão": "5",
                "Código Contratado": supplier, "Nome Contratado": "Olaria Irmãos Leão",
                "Data Assinatura Contrato": "29/02/2024", "Data Fim Vigência": "31/12/2026",
                "Valor Inicial Compra": value, "Valor Final Compra": value,
            }

        months = {
            "202401": [bought("K0", written(9), "1,00")],
            "202402": [bought("K1", written(1), "120,00"), bought("K2", written(7), "5.000,00")],
            "202403": [bought("K1", written(1), "130,00"), bought("K3", "987.654.321-00", "7,00")],
        }
        for month, rows in months.items():
            self.put(f"compras/{month}_compras.zip", f"{month}_Compras.csv", PURCHASE_HEADER, rows)

    def register(self):
        def part(kind, number, columns, rows, when="2024-06"):
            self.put(f"cnpj/{when}/{kind}{number}.zip", "dados", columns, rows, header=False)

        def partner(n, name, digits):
            return {"cnpj_basico": root(n), "nome_socio": name, "cnpj_cpf_socio": f"***{digits}**"}

        def office(n, opened):
            return {
                "cnpj_basico": root(n), "cnpj_ordem": "0001", "cnpj_dv": f"{n:02d}",
                "matriz_filial": "1", "data_inicio_atividade": opened, "cnae_principal": "2391",
                "uf": "RS", "municipio": "8801",
            }

        part("Socios", 0, schemas.REGISTER_PARTNERS, [partner(1, "OLD", "1")], "2024-05")
        part("Socios", 0, schemas.REGISTER_PARTNERS,
             [partner(1, "Lia  Terra", "777001"), partner(1, "CAIO", "000000"), partner(9, "CAIO", "000000")])
        part("Socios", 3, schemas.REGISTER_PARTNERS, [partner(8, "LÍA TERRA", "777001")])
        part("Empresas", 1, schemas.REGISTER_COMPANIES,
             [{"cnpj_basico": root(n), "razao_social": f"N{n}"} for n in range(1, 10) if n != 5])
        part("Estabelecimentos", 2, schemas.REGISTER_ESTABLISHMENTS,
             [office(1, "20100304"), office(8, "20240105"), office(9, "20240105")])


@pytest.fixture
def landed(tmp_path):
    folder = Folder(tmp_path / "in")
    folder.sanctions()
    folder.purchases()
    folder.register()
    return batch.Landed(*(str(tmp_path / "in" / d) for d in ("sancoes", "compras", "cnpj", "pncp")))


def test_all_stages(spark, tmp_path, as_of, landed):
    out = str(tmp_path / "out")
    counts = batch.run(spark, landed, out, as_of, batch.Scope(since="2024-02"))
    assert {r[0]: r[1] for r in counts["sancoes"].collect()} == {
        "CEIS": 3, "CEPIM": 2, "CNEP": 1, "LENIENCIA": 1,
    }
    assert {r[0]: r[1] for r in counts["contratos"].collect()} == {"PORTAL": 3}
    assert {r[0]: r[1] for r in counts["cadastro"].collect()} == {
        "universo_base": 7, "universo": 8, "socios": 3, "empresas": 7, "estabelecimentos": 2,
    }
    assert counts["vinculos"].first().asDict() == {
        "vinculos": 1, "vinculos_alta": 1, "grau0": 5, "grau1": 1, "indicio_sucessora": 1,
    }
    early = TableStore(spark, str(tmp_path / "early"))
    until = batch.load_contracts(early, landed, batch.Scope(since="2024-01"), date(2024, 1, 31))
    assert [tuple(r) for r in until.collect()] == [("PORTAL", 1)]
    assert tuple(counts["radar"].first()) == (1, 1, Decimal("130.00"))

    store = TableStore(spark, out)
    by_process = {r["processo"]: r for r in store.read("sancoes").collect() if r["processo"]}
    assert {p: r["vigente"] for p, r in by_process.items()} == {
        "A/1": True, "A/2": False, "A/3": True, "B/1": True,
    }
    assert by_process["A/1"]["nome_normalizado"] == "USINAGEM PAO & MEL S/A"
    assert by_process["B/1"]["valor_multa"] == Decimal("87000.10")
    agreement = store.read("sancoes").filter("fonte = 'LENIENCIA'").first()
    assert (agreement["nome"], agreement["cnpj_cpf"]) == ("Cinco Irmãs", root(5) + "000105")
    latest = store.read("contratos").filter("numero_contrato = 'K1'").first()
    assert (latest["competencia"], latest["valor_final"]) == ("202403", Decimal("130.00"))
    assert latest["data_assinatura"] == date(2024, 2, 29)
    assert latest["nome_contratado_normalizado"] == "OLARIA IRMAOS LEAO"
    assert {r[0] for r in store.read("universo").collect()} == {root(n) for n in range(1, 9)}
    assert {tuple(r) for r in store.read("socios").select("cnpj_basico", "chave_socio").collect()} == {
        (root(1), "LIA TERRA|777001"), (root(8), "LIA TERRA|777001"), (root(1), "CAIO|000000"),
    }


def test_a_reopened_store_reads_what_was_written(spark, tmp_path):
    rows = spark.createDataFrame([("202401", "", "PORTAL"), ("202402", "a", "")], "competencia string, "
                                 "numero_contrato string, origem string")
    store = TableStore(spark, str(tmp_path / "s"))
    before = store.write("t", rows, partition_by=["competencia"])
    again = TableStore(spark, str(tmp_path / "s")).read("t")
    assert again.schema == before.schema
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, before.collect()))


def test_other_spheres_do_not_read_purchases(spark, tmp_path, landed):
    folder = tmp_path / "in" / "pncp" / "competencia=202405"
    folder.mkdir(parents=True)
    page = {"data": [
        {"numeroControlePNCP": f"{state}-{n}", "orgaoEntidade": {"cnpj": "4", "esferaId": "M"},
         "unidadeOrgao": {"ufSigla": state}, "niFornecedor": "8", "valorGlobal": 2.25}
        for state in ("AC", "TO") for n in range(3)
    ]}
    (folder / "0001.json").write_text(json.dumps(page))
    store = TableStore(spark, str(tmp_path / "out"))
    scope = batch.Scope(spheres=("M",), state="TO", since="2024-05")
    assert [tuple(r) for r in batch.load_contracts(store, landed, scope).collect()] == [("PNCP", 3)]


def test_absent_files_are_named(spark, tmp_path, as_of, landed):
    store = TableStore(spark, str(tmp_path / "out"))
    (tmp_path / "nothing").mkdir()
    with pytest.raises(FileNotFoundError, match="ceis"):
        batch.load_sanctions(store, str(tmp_path / "nothing"), as_of)
    with pytest.raises(FileNotFoundError, match="2031-07"):
        batch.load_contracts(store, landed, batch.Scope(since="2031-07"))


@pytest.mark.parametrize("wrong", [{"spheres": ("Q",)}, {"since": "2024-13"}])
def test_scope_is_checked(wrong):
    with pytest.raises(ValueError):
        batch.Scope(**wrong)
