from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with an extra column whose name an operator also uses."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(full, f"{DOCS}, score string")

    return make
