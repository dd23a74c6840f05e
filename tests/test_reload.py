"""Contracts kept up to date by manifest, against a full load after every change."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from catalogue.standin import PURCHASE_HEADER
from contraluz.plans import contracts, monthly, reload, reports
from contraluz.sources import delimited, landing, manifest
from contraluz.tables import TableStore


class Months:
    """Month files in one folder, and what a load reads of them."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.paths, self.fails = spark, folder, [], False

    def put(self, month, rows, name="a.csv"):
        target = self.folder / f"{month}_Compras" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("w", encoding="latin-1", newline="") as file:
            out = csv.DictWriter(file, PURCHASE_HEADER, restval="", delimiter=";", quoting=csv.QUOTE_ALL)
            out.writeheader()
            for number, supplier, value in rows:
                out.writerow({
                    "Número do Contrato": number, "Código UG": "7", "Código Contratado": supplier,
                    "Nome Contratado": "Padaria Céu", "Valor Final Compra": value,
                    "Código Órgão": number[-1], "Nome Órgão": f"O {number}", "Data Fim Vigência": "01/02/2026",
                })

    def read(self, paths):
        if self.fails:
            raise RuntimeError("read failed")
        self.paths = paths
        raw = delimited.with_period(delimited.read_with_header(self.spark, paths))
        month = manifest.month_of_purchase(F.col("_arquivo")).alias("mes_arquivo")
        return contracts.from_purchases(raw, keep=[month])

    def source(self):
        files = landing.list_files(self.spark, str(self.folder), "*.csv")
        return reload.Source(manifest.entries(files, "PORTAL", manifest.month_of_purchase(F.col("path"))), self.read)

    def full(self):
        raw = delimited.with_period(delimited.read_with_header(self.spark, f"{self.folder}/*/*.csv"))
        return _rows(contracts.contracts_table(["F"], purchases=raw))


def _rows(df):
    return sorted((r["competencia"], r["numero_contrato"], r["cnpj_contratado"], r["valor_final"]) for r in df.collect())


def test_reload_reads_changed_months_only(spark, tmp_path, as_of):
    one, two = "11222333000144", "55666777000188"
    months, store = Months(spark, tmp_path / "landed"), TableStore(spark, str(tmp_path / "tables"))
    months.put("202401", [("K0", one, "1,00"), ("K1", one, "2,00"), ("K9", two, "9,00")])
    months.put("202402", [("K1", one, "3,00"), ("K2", two, "4,00")])
    months.put("202403", [("K3", two, "5,00"), ("K9", two, "8,00")])

    def run():
        months.paths = []
        changed = reload.reload_contracts(store, months.source(), None, lambda m: monthly.refresh(store, m))["PORTAL"]
        table = TableStore(spark, store.folder).read("contratos")
        assert _rows(table) == months.full()
        alert = spark.createDataFrame([(one[:8],)], "cnpj_basico string")
        assert monthly.agencies_ranking(store, alert).collect() == reports.agencies_ranking(table, alert).collect()
        assert monthly.radar_summary(store, alert, as_of).collect() == reports.radar_summary(table, alert, as_of).collect()
        assert {p.split("/")[-2][:6] for p in months.paths} <= set(changed)
        return changed

    assert run() == ["202401", "202402", "202403"]
    assert run() == [] and months.paths == []
    # a version is withdrawn: the older one comes back; a contract moves to a later month
    months.put("202402", [("K2", two, "4,50"), ("K0", one, "7,00"), ("K5", one, "1,50")])
    assert run() == ["202402"]
    # a second file of a month, a repeated row and a later month
    months.put("202402", [("K6", two, "6,00"), ("K6", two, "6,00")], "b.csv")
    months.put("202404", [("K9", two, "7,77")])
    assert run() == ["202402", "202404"]
    # a month that has a file but no rows now, and one whose file is gone
    months.put("202403", [])
    assert run() == ["202403"]
    (tmp_path / "landed/202404_Compras/a.csv").unlink()
    assert run() == ["202404"]
    assert "202404" not in {r[0] for r in months.full()}


def test_a_run_that_died_is_run_again(spark, tmp_path):
    one = "11222333000144"
    months, store = Months(spark, tmp_path / "landed"), TableStore(spark, str(tmp_path / "tables"))
    months.put("202401", [("K0", one, "1,00"), ("K1", one, "2,00")])
    months.put("202402", [("K0", one, "3,00")])
    reload.reload_contracts(store, months.source(), None)
    months.put("202402", [("K7", one, "9,00")])
    months.fails = True  # after the old rows of the month are gone
    with pytest.raises(RuntimeError):
        reload.reload_contracts(store, months.source(), None)
    months.fails = False
    seen = []

    def dies(replaced):
        seen.append(replaced)
        raise RuntimeError("died late")

    with pytest.raises(RuntimeError):  # after the contracts are replaced: both months changed
        reload.reload_contracts(store, months.source(), None, dies)
    assert reload.reload_contracts(store, months.source(), None, seen.append)["PORTAL"] == ["202402"]
    assert seen == [["202401", "202402"]] * 2
    assert _rows(store.read("contratos")) == months.full()
    assert store.read("contratos_pendentes").count() == 0


def test_pages_and_purchases_in_one_table(spark, tmp_path):
    one = "11222333000144"
    months, store = Months(spark, tmp_path / "landed"), TableStore(spark, str(tmp_path / "tables"))
    months.put("202401", [("K0", one, "1,00")])
    months.put("202402", [("K1", one, "3,00")])
    held = {"202401": 3, "202403": 2}

    def page_rows(paths):
        rows = [(m, i) for m, n in held.items() for i in range(n) if any(f"/{m}" in p for p in paths)]
        base = contracts.from_purchases(months.read([p for p in sorted(map(str, (tmp_path / "landed").rglob("a.csv")))][:1]).select(*[
            F.lit(None).cast("string").alias(c) for c in PURCHASE_HEADER], "competencia")).limit(0)
        names = {c: F.lit(None).cast(t) for c, t in base.dtypes}
        made = spark.createDataFrame(rows, "competencia string, n int")
        return made.select(*[
            {"origem": F.lit("PNCP"), "competencia": F.col("competencia"), "numero_contrato": F.col("n").cast("string")}.get(c, names[c]).alias(c)
            for c in base.columns])

    def pages(sizes):
        rows = [("PNCP", m, f"/pages/{m}/1.json", n, None, "") for m, n in sizes.items()]
        files = spark.createDataFrame(rows, "origem string, mes string, path string, tamanho long, modificado timestamp, escopo string")
        return reload.Source(files.withColumn("modificado", F.lit("2024-01-01").cast("timestamp")), page_rows)

    def counts():
        return {(r["origem"], r["competencia"]): r["count"] for r in store.read("contratos").groupBy("origem", "competencia").count().collect()}

    reload.reload_contracts(store, months.source(), pages(held))
    assert counts() == {("PORTAL", "202401"): 1, ("PORTAL", "202402"): 1, ("PNCP", "202401"): 3, ("PNCP", "202403"): 2}
    held["202401"] = 5
    assert reload.reload_contracts(store, months.source(), pages(held)) == {"PORTAL": [], "PNCP": ["202401"]}
    assert counts()[("PNCP", "202401")] == 5 and counts()[("PORTAL", "202401")] == 1
    del held["202403"]
    reload.reload_contracts(store, months.source(), pages(held))
    assert ("PNCP", "202403") not in counts()
    # a source that is left out takes its rows along
    reload.reload_contracts(store, months.source(), None)
    assert counts() == {("PORTAL", "202401"): 1, ("PORTAL", "202402"): 1}


def test_partition_values_are_plain(spark, tmp_path):
    with pytest.raises(ValueError):
        TableStore(spark, str(tmp_path)).drop_partitions("t", "mes", ["../x"])
