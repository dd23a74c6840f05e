"""SimHash, components, decontamination and top-k against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from contraluz.llm import decontaminate, simhash, topk
from contraluz.llm.components import connected_components


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps):
    label = dict.fromkeys(fps)
    for start in sorted(fps):
        stack = [start] if label[start] is None else []
        while stack:
            at = stack.pop()
            if label[at] is None:
                label[at] = start
                stack += [o for o in fps if label[o] is None and (fps[at] ^ fps[o]).bit_count() <= 3]
    return label


@pytest.mark.parametrize("text", [None, "", " \n", "One", "two Words", "a b c d a b c", "É b c ÀÉ d\x1cx y"])
def test_fingerprint_follows_its_definition(text):
    assert simhash.fingerprint_text(text) == naive_fingerprint(text)


def test_fingerprint_of_a_long_text():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") for _ in range(90_000))
    assert simhash.fingerprint_text(text) == naive_fingerprint(text)


def test_forest_equals_all_pairs():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = np.unique([s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (40, 2))])
    table = simhash.pivot_table(fps, simhash.reference_fingerprints())
    label, survived, linked = simhash.linked_forest(fps, table, np.zeros(len(fps), int))
    want = naive_components({i: int(f) for i, f in enumerate(fps)})
    assert [want[i] for i in range(len(fps))] == label.tolist()
    assert 0 < linked <= survived


@pytest.mark.parametrize("cell", [simhash.CELL, 4])
def test_near_duplicates_against_brute_force(spark, docs, cell, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)]
    for n in range(60):
        near = base[n % 3].split(" ")
        near[rng.randrange(300)] = "other"
        rows.append((100 + n, " ".join(near)))
    rows += [(200, base[0]), (201, base[0]), (300, None), (301, ""), (302, "\n"), (7, base[5]), (7, base[5])]
    monkeypatch.setattr(simhash, "near_links", lambda n, f=simhash.near_links: f(n, cell))
    got = simhash.near_duplicates(docs([*rows, (None, base[1])])).collect()
    want = naive_components({i: naive_fingerprint(t) for i, t in rows})
    assert len(got) == len(rows) + 1
    assert {r["id"]: r["component"] for r in got} == {**want, None: None}


def test_one_of_each_group_and_empty_table(docs):
    rows = [(3, "same text here now"), (1, "same text here now"), (None, "same text here now"), (9, "all else is new")]
    kept = simhash.one_of_each_group(docs(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "9", "None"]
    assert kept.columns == docs([]).columns
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (3, 2)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["a"]: r["component"] for r in found} == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def naive_hits(text, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: cut.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit |= {*range(i, i + size)}
                found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most", [decontaminate.MAX_PATTERN_WORDS, 150])
def test_contamination_against_brute_force(spark, docs, most):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(str(i), text(rng.randrange(1, 30))) for i in range(12)] + [("x", "éa, B"), ("n", None), ("e", "..!")]
    rows = [(i, text(rng.randrange(0, 200))) for i in range(30)]
    rows += [(50, None), (51, ""), (52, "ÉA b éa-b"), (53, items[3][1].upper()), (53, items[3][1].upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate.contamination(docs(rows), bench, name="h", max_pattern_words=most)
    got = found.select("doc_id", "h.*", decontaminate.items_digest("h.items").alias("d")).collect()
    want = {i: naive_hits(t, items) for i, t in rows}
    assert len(got) == len(rows)
    assert all((r["n_words"], r["n_hit"], len(r["items"]), r["d"]) == want[r["doc_id"]] for r in got)


def test_contamination_without_items(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(docs([(1, "a b")]), bench, name="h").select("h.n_words", "h.n_hit")
    assert [tuple(r) for r in found.collect()] == [(2, 0)]
    assert decontaminate.contamination(docs([]), bench, name="h").count() == 0


@pytest.mark.parametrize("block", [topk.BLOCK, 2])
def test_top_k_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 1.0, 0.5, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(500, [1.0, 1.0]), (500, [1.0, 1.0]), (550, []), (600, None), (650, [None, 1.0]), (700, [float("nan")] * 6)]
    rows += [(None, [9.0] * 6), (750, [float("inf")] * 6)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, block=block).collect()
    whole = {i: [np.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q, v in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole.items() if c != q)
            want |= {(q, n + 1, c, int(-s)) for n, (s, c) in enumerate(scores[:5])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(make([]), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(make([(50, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    two = topk.top_k(make([(50, [1.0]), (51, [-1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in two] == [(50, 1, 51, -65536)]


def naive_top_k(rows, k=5):
    """(query, rank, candidate, exact score) of every query row; rows are distinct (id, vector)."""
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.BLOCK, 3])
def test_top_k_of_ids_with_several_vectors(spark, block):
    rng = np.random.default_rng(8)
    rows = [(50, [float(n), 8.0, 1.0]) for n in range(10)] + [(100, [3.0, 0.5, -2.0]), (51, [2.0, 1.0, 0.0])]
    rows += [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(1, 7)]
    rows += [(52, [float(n), 9.0, 9.0]) for n in range(12)]  # a candidate with many vectors
    rows += [(53, [9.0, 8.0, 1.0]), (150, [4.0, 8.0, 1.0])]  # equal to vectors of the first id
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, block=block).collect()
    assert sorted(map(tuple, got)) == naive_top_k(rows)
    alone = spark.createDataFrame(rows[:10], "vec_id long, embedding array<double>")
    assert topk.top_k(alone, F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("largest", [3e5, 1e9, 1e15])
def test_top_k_of_large_components(spark, largest):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.round(rng.uniform(-largest, largest, 5), 2)]) for i in range(60)]
    rows += [(i + 100, [x + 1 / 256 for x in v]) for i, v in rows[:40]]  # scores that doubles confuse
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0, 0.25 * i]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    bound = (1 << 63) - 1
    want = [(q, n, c, max(-bound - 1, min(bound, s))) for q, n, c, s in naive_top_k(rows)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert largest < 1e9 or any(s == bound for *_, s in want)


def test_top_k_of_the_largest_floats(spark):
    rows = [(50, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [-3e38, 2.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 2] and got[0]["score"] == (1 << 63) - 1
