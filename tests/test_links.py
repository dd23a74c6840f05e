from __future__ import annotations

import random
from datetime import date
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from contraluz.operators.hot_groups import grid_join, pairs_within
from contraluz.plans import links, risk

PARTNERS = "cnpj_basico string, nome_socio string, cpf_mascarado string"
OFFICES = (
    "cnpj_basico string, matriz_filial string, cnae_principal string, municipio_codigo string, "
    "uf string, data_inicio_atividade date"
)


def test_a_name_beyond_the_limit_links_nothing_by_name_alone(spark):
    """Names in 3 to 7 companies, without documents, against a limit of 5."""
    rows = [(f"{100 * size + i:08d}", f"NAME IN {size}", "") for size in range(3, 8) for i in range(size)]
    held = links.holdings(spark.createDataFrame(rows, PARTNERS))
    counts = links.medium_links(held, 5).groupBy("socio_comum").count().collect()
    assert {r[0]: r[1] for r in counts} == {f"NAME IN {n}": n * (n - 1) // 2 for n in (3, 4, 5)}
    beyond = {tuple(r) for r in links.hyperconnectors(held, 5).collect()}
    assert beyond == {("NAME IN 6", 6), ("NAME IN 7", 7)}


def test_successor_needs_all_of_its_conditions(spark):
    """Company 0 is sanctioned; the others share its partner and miss one condition each."""
    roots = [f"{70 + i:08d}" for i in range(5)]
    held = links.holdings(spark.createDataFrame([(r, "X Y", "***555555**") for r in roots], PARTNERS))
    late, early = date(2015, 2, 2), date(2001, 2, 2)
    offices = spark.createDataFrame(
        [(roots[0], "1", "11", "A", "UF", early), (roots[1], "1", "11", "A", "UF", late),
         (roots[2], "1", "22", "A", "UF", late), (roots[3], "1", "11", "B", "UF", late),
         (roots[4], "1", "11", "A", "UF", early)],
        OFFICES,
    )
    sanctioned = risk.degree0(
        spark.createDataFrame(
            [(roots[0] + "000199", True, date(2012, 6, 6)), (roots[4] + "000199", False, early)],
            "cnpj_cpf string, vigente boolean, data_inicio date",
        )
    )
    found = risk.company_risk(held, sanctioned, offices).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {
        r: (0 if i == 0 else 1, i == 1) for i, r in enumerate(roots)
    }


def brute_links(rows, limit):
    """Links by definition, over distinct (company, name, document)."""
    best = {}
    companies = {}
    for root, name, _ in rows:
        companies.setdefault(name, set()).add(root)
    for (r1, n1, d1), (r2, n2, d2) in combinations(sorted(rows), 2):
        if n1 != n2 or r1 == r2:
            continue
        key = (min(r1, r2), max(r1, r2), n1)
        if d1 == d2 and d1 not in ("", "000000"):
            best[key] = "alta"
        elif "" in (d1, d2) and (limit is None or len(companies[n1]) <= limit):
            best.setdefault(key, "media")
    return best


def random_holdings(seed, hot):
    rng = random.Random(seed)
    rows = set()
    for _ in range(300):
        name = "QUENTE" if rng.random() < hot else f"N{rng.randrange(25)}"
        doc = rng.choice(["", "000000", "111111", "111111", "222222"])
        rows.add((f"{rng.randrange(60):08d}", name, doc))
    return sorted(rows)


@pytest.mark.parametrize("cell", [4, 10_000])
def test_links_without_the_rule_on_frequent_names(spark, cell):
    rows = random_holdings(5, hot=1 / 3)
    held = spark.createDataFrame(rows, "cnpj_basico string, nome_socio string, doc string")
    want = brute_links(rows, None)
    assert {tuple(r)[:3]: r[3] for r in links.links(held, None, cell).collect()} == want
    origins = spark.createDataFrame([(f"{i:08d}",) for i in range(0, 60, 9)], "cnpj_basico string")
    seen = {(r["origem"], r["outra"], r["socio_comum"]): r["confianca"]
            for r in links.links_from(held, origins, None, cell).collect()}
    wanted = {r[0] for r in origins.collect()}
    assert seen == {
        (one, other, n): c
        for (a, b, n), c in want.items()
        for one, other in ((a, b), (b, a))
        if one in wanted
    }


def test_only_names_of_the_origins_are_grouped(spark):
    held = spark.createDataFrame([("1", "A", "")], "cnpj_basico string, nome_socio string, doc string")
    plan = links.medium_links_seen(held, spark.createDataFrame([("1",)], "cnpj_basico string"), 5)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Window [") < text.index("LeftSemi, (nome_socio")


@pytest.mark.parametrize("seed,cell", [(1, 10_000), (2, 4), (3, 1)])
def test_against_brute_force(spark, seed, cell):
    """A third of the rows share one name; tiny cells force the split of hot groups."""
    rows = random_holdings(seed, hot=1 / 3)
    held = spark.createDataFrame(rows, "cnpj_basico string, nome_socio string, doc string")
    limit = 6
    want = brute_links(rows, limit)
    got = {tuple(r)[:3]: r[3] for r in links.links(held, limit, cell).collect()}
    assert got == want
    assert all(a < b for a, b, _ in got)

    zero = {f"{i:08d}": date(2000, 1, 1 + i % 5) for i in range(0, 60, 7)}
    sanctioned = spark.createDataFrame(
        list(zero.items()), "cnpj_basico string, primeira_sancao_vigente date"
    )
    edges = {
        tuple(r) for r in risk.risk_edges(held, sanctioned, limit, cell).collect()
    }
    assert edges == {
        (other, origin, n, c)
        for (a, b, n), c in want.items()
        for origin, other in ((a, b), (b, a))
        if origin in zero
    }
    rng = random.Random(seed)
    offices = [
        (f"{i:08d}", "1", rng.choice("AB"), rng.choice(["1", "2", None]), "SC",
         date(2000, 1, rng.randrange(1, 9)))
        for i in range(60)
    ]
    table = spark.createDataFrame(offices, OFFICES)
    pairs = risk.risk_degrees(held, sanctioned, table, limit, cell)
    grouped = pairs.groupBy("cnpj_basico").agg(
        F.min("grau"), F.bool_or("indicio_sucessora")
    )
    linear = risk.company_risk(held, sanctioned, table, limit)
    assert sorted(map(tuple, linear.collect())) == sorted(map(tuple, grouped.collect()))
    assert grouped.filter("`bool_or(indicio_sucessora)`").count() > 0


@pytest.mark.parametrize("cell,few", [(1, 100), (3, 100), (3, 0), (1000, 100)])
def test_pairs_within_and_grid_join(spark, cell, few):
    left = [("k", i) for i in range(17)] + [("m", i) for i in range(3)] + [("only", 1)]
    right = [("k", i) for i in range(11)] + [("m", 5)]
    ldf = spark.createDataFrame(left, "k string, a long")
    rdf = spark.createDataFrame(right, "k string, b long")
    got = sorted(map(tuple, grid_join(ldf, rdf, ["k"], "a", "b", cell, few).select("k", "a", "b").collect()))
    assert got == sorted((k, a, b) for k, a in left for j, b in right if j == k)
    pairs = sorted(map(tuple, pairs_within(ldf, ["k"], "a", cell, few).collect()))
    assert pairs == sorted(
        (k, a, b) for (k, a), (j, b) in combinations(sorted(left), 2) if k == j
    )


def test_hot_group_is_spread(spark):
    """One key with 4,000 members: its pairs come from many tasks, not one."""
    df = spark.range(4000).select(F.lit("x").alias("k"), F.col("id").alias("m"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        pairs = pairs_within(df, ["k"], "m", 250)
        sizes = [
            r["n"]
            for r in pairs.groupBy(F.spark_partition_id().alias("p"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sum(sizes) == 4000 * 3999 // 2
    assert max(sizes) < sum(sizes) / 5
