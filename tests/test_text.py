from __future__ import annotations

import unicodedata
from datetime import date
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contraluz.functions import text


def test_normalize_cnpj(scalar):
    values = ["12.345.678/0001-95", "1.234.567/0001-95", "", "sem dígitos", "123456789012345", None]
    assert scalar(text.normalize_cnpj, values) == [
        "12345678000195", "01234567000195", "", "", "123456789012345", None,
    ]


def test_normalize_name(scalar):
    values = ["  João   da  Silva Júnior ", "Construções Açaí Ltda.", "José Ávila", "straße", None]
    assert scalar(text.normalize_name, values) == [
        "JOAO DA SILVA JUNIOR", "CONSTRUCOES ACAI LTDA.", "JOSE AVILA", "STRASSE", None,
    ]


def test_strip_accents_keeps_letters_without_decomposition(scalar):
    assert scalar(text.strip_accents, ["Ørsted ıŁ ạỹ"]) == ["Ørsted ıŁ ay"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F)), min_size=1))
def test_strip_accents_like_unicode(values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = [r["y"] for r in rows.select("i", text.strip_accents(F.col("x")).alias("y")).orderBy("i").collect()]
    want = [
        "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn")
        for v in values
    ]
    assert got == want


def test_partner_key(spark):
    rows = spark.createDataFrame(
        [("José Ávila", "***123456**"), ("Ana", None), (None, "1")], "n string, d string"
    )
    key = text.partner_key(F.col("n"), F.col("d")).alias("k")
    assert [r["k"] for r in rows.select(key).collect()] == ["JOSE AVILA|123456", "ANA|", None]


def test_company_root(scalar):
    assert scalar(text.company_root, ["12345678000195", "12345678901", "", None]) == [
        "12345678", None, None, None,
    ]


def test_dates(scalar):
    values = ["15/03/2025", " 1/4/2025 ", "", "31/02/2024", "abc", "2025-03-15", "01/01/24", None]
    assert scalar(text.parse_date_br, values) == [
        date(2025, 3, 15), date(2025, 4, 1), None, None, None, None, None, None,
    ]
    compact = ["20181123", " 20181123", "00000000", "2018112", "", None]
    assert scalar(text.parse_date_compact, compact) == [
        date(2018, 11, 23), date(2018, 11, 23), None, None, None, None,
    ]


def test_money(scalar):
    values = ["1.234.567,89", " 10,5 ", "1000", "R$ 1,00", "", None, "0,005"]
    assert scalar(text.parse_money_br, values) == [
        Decimal("1234567.89"), Decimal("10.50"), Decimal("1000.00"), None, None, None,
        Decimal("0.01"),
    ]
    assert scalar(text.parse_decimal_comma, ["1000,00", "x", None]) == [
        Decimal("1000.00"), None, None,
    ]


def test_sanction_class_first_pattern_wins(scalar):
    values = [
        "Declaração de INIDONEIDADE", "Suspensão", "Impedimento/proibição", "Acordo de LENIÊNCIA (x)",
        "Entidade impedida (CEPIM)", "Multa", "PUBLICAÇÃO EXTRAORDINÁRIA", "Outra",
        "multa e suspensão",
    ]
    assert scalar(text.sanction_class, values) == [
        "INIDONEIDADE", "SUSPENSAO", "IMPEDIMENTO", "LENIENCIA", "ENTIDADE_IMPEDIDA", "MULTA",
        "PUBLICACAO_EXTRAORDINARIA", "REGISTRADA", "SUSPENSAO",
    ]


def test_clean_object_text(scalar):
    values = ["Objeto:  Obra", "??????Execução ", "objeto: ??  Serviço\n", "Objeto: ", "", None]
    assert scalar(text.clean_object_text, values) == [
        "Obra", "Execução", "Serviço", "—", "—", "—",
    ]


def test_status_label(scalar):
    assert scalar(text.status_label, ["02", "99", "", None]) == ["Ativa", "99", "—", "—"]


def test_risk_badge(spark):
    rows = spark.createDataFrame(
        [(0, False), (1, True), (1, False), (None, False)], "g int, s boolean"
    )
    badge = text.risk_badge(F.col("g"), F.col("s")).alias("b")
    assert [r["b"] for r in rows.select(badge).collect()] == [
        text.BADGE_SANCTIONED, text.BADGE_SUCCESSOR, text.BADGE_LINKED, text.BADGE_CLEAR,
    ]
