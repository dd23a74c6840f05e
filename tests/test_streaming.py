from __future__ import annotations

import os
from decimal import Decimal

from contraluz.plans import contracts
from contraluz.schemas import CONTRACTS
from catalogue.standin import PURCHASE_HEADER
from contraluz.streaming.refresh import refresh_on_landing


def land(folder, batch, month, rows, when, part=""):
    target = folder / batch / f"{month}_Compras{part}.csv"
    target.parent.mkdir(parents=True, exist_ok=True)
    lines = [";".join(f'"{c}"' for c in PURCHASE_HEADER)]
    lines += [";".join(f'"{r.get(c, "")}"' for c in PURCHASE_HEADER) for r in rows]
    target.write_bytes("\r\n".join(lines).encode("iso-8859-1"))
    os.utime(target, (when, when))


def row(number, value):
    return {
        "Número do Contrato": number, "Código UG": "1", "Código Contratado": "12.345.678/0001-95",
        "Valor Final Compra": value, "Nome Contratado": "Fornecedora Ção",
    }


def test_late_month_replaces_itself(spark, tmp_path):
    landed, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")

    def take_in():
        refresh_on_landing(spark, str(landed), PURCHASE_HEADER, table, check).awaitTermination()
        return spark.read.schema(CONTRACTS).parquet(table)

    land(landed, "a", "202503", [row("C-1", "1,00"), row("C-2", "2,00")], 1_000_000)
    land(landed, "a", "202504", [row("C-1", "3,00")], 1_000_001)
    first = take_in()
    assert sorted((r["competencia"], r["numero_contrato"]) for r in first.collect()) == [
        ("202503", "C-1"), ("202503", "C-2"), ("202504", "C-1"),
    ]
    land(landed, "b", "202504", [row("C-1", "4,00"), row("C-3", "5,00")], 1_000_002)
    latest = contracts.latest_versions(take_in())
    got = {r["numero_contrato"]: r["valor_final"] for r in latest.collect()}
    assert got == {"C-1": Decimal("4.00"), "C-2": Decimal("2.00"), "C-3": Decimal("5.00")}
    assert latest.first()["nome_contratado_normalizado"] == "FORNECEDORA CAO"


def test_a_month_in_two_files_keeps_both(spark, tmp_path):
    landed, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    land(landed, "a", "202503", [row("C-1", "1,00")], 1_000_000, "_1")
    land(landed, "a", "202503", [row("C-2", "2,00")], 1_000_001, "_2")
    refresh_on_landing(spark, str(landed), PURCHASE_HEADER, table, check).awaitTermination()
    land(landed, "b", "202503", [row("C-3", "3,00")], 1_000_002, "_2")
    refresh_on_landing(spark, str(landed), PURCHASE_HEADER, table, check).awaitTermination()
    got = spark.read.schema(CONTRACTS).parquet(table)
    assert sorted(r["numero_contrato"] for r in got.collect()) == ["C-1", "C-3"]
