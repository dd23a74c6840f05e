"""Column expressions used by every load. All are built-ins, so they stay inside codegen."""

from __future__ import annotations

import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace classes are spelled out: engines disagree on what \s covers.
_SPACES = r"[\t\n\f\r ]+"
_ANY_SPACE = (
    r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
)


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decomposition."""
    accented, base = [], []
    for code in chain(range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        letter = chr(code)
        stripped = "".join(
            c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn"
        )
        if stripped != letter and len(stripped) == 1:
            accented.append(letter)
            base.append(stripped)
    return "".join(accented), "".join(base)


_ACCENTED, _BASE = _accent_table()


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def strip_accents(c: Column) -> Column:
    """Drop accents; plain ASCII values skip the replacement altogether."""
    stripped = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), _ACCENTED, _BASE)
    return F.when(is_ascii(c), c).otherwise(stripped)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def normalize_name(c: Column) -> Column:
    """Upper case, no accents, single spaces."""
    return F.regexp_replace(F.trim(F.upper(strip_accents(c))), _SPACES, " ")


def normalize_cnpj(c: Column) -> Column:
    """Digits left-padded to 14. Longer input is kept whole; no digits stays empty."""
    d = digits_only(c)
    return F.when((d == "") | (F.length(d) >= 14), d).otherwise(F.lpad(d, 14, "0"))


def company_root(c: Column) -> Column:
    """First 8 digits of a 14-digit company id; null for person ids (11 digits)."""
    return F.when(F.length(c) == 14, F.substring(c, 1, 8))


def document_digits(c: Column) -> Column:
    return digits_only(F.coalesce(c, F.lit("")))


def partner_key(name: Column, document: Column) -> Column:
    """Matching key: normalised name, bar, document digits. Null when the name is null."""
    return F.concat(normalize_name(name), F.lit("|"), document_digits(document))


def parse_date_br(c: Column) -> Column:
    """``dd/mm/yyyy``; one-digit day or month accepted, anything else is null."""
    return F.try_to_date(blank_to_null(c), "d/M/yyyy")


def parse_date_compact(c: Column) -> Column:
    """``yyyymmdd``; anything else is null."""
    return F.try_to_date(blank_to_null(c), "yyyyMMdd")


def parse_money_br(c: Column) -> Column:
    """``1.234.567,89`` to decimal(18,2); anything else is null."""
    plain = F.replace(F.replace(blank_to_null(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("decimal(18,2)")


def parse_decimal_comma(c: Column) -> Column:
    """``1000,00`` to decimal(18,2); anything else is null."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


# Sanction classes in order of precedence, with the pattern that selects each.
SANCTION_CLASSES = [
    ("INIDONEIDADE", "inidon"),
    ("SUSPENSAO", "suspens"),
    ("IMPEDIMENTO", "impedimento"),
    ("LENIENCIA", "leni[êe]ncia"),
    ("ENTIDADE_IMPEDIDA", "cepim|entidade impedida"),
    ("MULTA", "multa"),
    ("PUBLICACAO_EXTRAORDINARIA", "publica[çc][ãa]o extraordin"),
]
SANCTION_CLASS_DEFAULT = "REGISTRADA"


def sanction_class(category: Column) -> Column:
    """Plain-language class of a sanction category: the first pattern found wins."""
    chain_ = F
    for code, pattern in SANCTION_CLASSES:
        chain_ = chain_.when(category.rlike(f"(?iu){pattern}"), F.lit(code))
    return chain_.otherwise(F.lit(SANCTION_CLASS_DEFAULT))


MISSING = "—"


def clean_object_text(c: Column) -> Column:
    """Contract object without the embedded label and the leading run of question marks."""
    no_label = F.regexp_replace(c, rf"(?iu)^objeto:{_ANY_SPACE}*", "")
    no_marks = F.regexp_replace(no_label, rf"^\?+{_ANY_SPACE}*", "")
    trimmed = F.regexp_replace(no_marks, rf"^{_ANY_SPACE}+|{_ANY_SPACE}+\z", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit(MISSING))


# Registration status codes of the company register.
STATUS_LABELS = {
    "01": "Nula",
    "02": "Ativa",
    "03": "Suspensa",
    "04": "Inapta",
    "08": "Baixada",
}


def status_label(code: Column) -> Column:
    """Label of a registration status; unknown codes pass through."""
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_LABELS.items())])
    return F.coalesce(
        F.try_element_at(labels, code), F.nullif(code, F.lit("")), F.lit(MISSING)
    )


# Risk labels shown for a company.
BADGE_SANCTIONED = "Sanção vigente"
BADGE_SUCCESSOR = "Vínculo com sancionada · possível sucessora"
BADGE_LINKED = "Vínculo com sancionada"
BADGE_CLEAR = "Sem alerta nos dados"


def risk_badge(degree: Column, successor: Column) -> Column:
    return (
        F.when(degree == 0, F.lit(BADGE_SANCTIONED))
        .when((degree == 1) & successor, F.lit(BADGE_SUCCESSOR))
        .when(degree == 1, F.lit(BADGE_LINKED))
        .otherwise(F.lit(BADGE_CLEAR))
    )
