"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
FOLDER = Path("/root/testdata/sf0.001")

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
sys.modules["spark_entry"] = entry
spec.loader.exec_module(entry)
sys.path.insert(0, str(ROOT / "tools"))
from catalogue.oracle import oracle_sql as catalogue_sql  # noqa: E402
from catalogue.queries import queries as catalogue_queries  # noqa: E402
from check_oracle import _canonical  # noqa: E402

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Queries run as in production: with whole-stage code."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    yield
    spark.conf.set(name, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(catalogue_queries()) == set(catalogue_sql())


@pytest.mark.parametrize("name", sorted(catalogue_queries()))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, str(FOLDER))
    plan = plan_of(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = con.execute(entry.oracle_sql()[name]).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert _canonical(got) == _canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    ["contracts_latest", "sanctions_unified", "links_medium"],
)
def test_ranked_queries_limit_before_the_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, str(FOLDER)))
    assert plan.count("WindowGroupLimit") == 2


def test_columns_and_filters_reach_the_scan(spark):
    plan = plan_of(entry.queries()["agencies_ranking"](spark, str(FOLDER)))
    contracts = [line for line in plan.splitlines() if "FileScan" in line and "valor_final" in line]
    assert len(contracts) == 1 and "objeto" not in contracts[0].split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull(orgao_codigo)]" in contracts[0]
    assert "SortAggregate" not in plan_of(entry.queries()["links"](spark, str(FOLDER)))


@pytest.mark.parametrize("name", ["company_sheet_risk", "company_sheet_sanctions", "company_sheet_partners"])
def test_sheets_are_not_sorted_as_a_whole(spark, name):
    assert "rangepartitioning" not in plan_of(entry.queries()[name](spark, str(FOLDER)))
