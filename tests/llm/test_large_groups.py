"""Near copies of large groups: rows in proportion to the texts, few bytes a shingle, right results."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

from contraluz.llm import near_copies

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_near_copies import naive_components  # noqa: E402

WORDS = [f"w{i}" for i in range(40)]


def large_group(count=150):
    """Texts about as far from each other as the limit: many pairs are similar, more are nearly so."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for n in range(count):
        text = list(base)
        for place in rng.sample(range(150), rng.randrange(1, 5)):
            text[place] = rng.choice(WORDS[:2])
        rows.append((n, " ".join(text)))
    return rows


@pytest.fixture
def written(monkeypatch):
    """Row counts of the pair tables that near_copies itself writes."""
    counts, write = [], near_copies.checkpointed

    def counted(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "checkpointed", counted)
    return counts


def test_rows_follow_the_texts_and_not_their_pairs(spark, docs, written):
    rows = large_group()
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs(rows)).collect()}
    want = naive_components(rows)
    assert got == want and 5 < len(set(want.values())) < len(rows) - 5
    assert written and max(written) <= 2 * len(rows)


def test_blocks_cut_into_parts_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(near_copies, "_BLOCK_SHINGLES", 2000)
    rows = large_group(90) + [(1000, large_group(1)[0][1]), (1001, None), (1002, "a b c")]
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs(rows).repartition(5)).collect()}
    assert got == naive_components(rows)


def test_shingles_are_dealt_in_few_bytes(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=600))) for i in range(60)]
    dealt = near_copies._dealt(docs(rows).coalesce(1), 40).collect()
    size = sum(len(r["nodes"]) + len(r["sizes"]) + len(r["tokens"]) for r in dealt)
    sets = {i: near_copies.shingle_set(t) for i, t in rows}
    assert size < 7 * sum(map(len, sets.values()))
    found = {}
    for r in dealt:
        names = np.repeat(np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["sizes"], np.uint32))
        octets = np.frombuffer(r["tokens"], np.uint8).reshape(-1, 5)
        tokens = [int.from_bytes(bytes(o), "little") for o in octets]
        assert all(t % 40 == r["part"] for t in tokens)
        for name, token in zip(names.tolist(), tokens, strict=True):
            found.setdefault(name, set()).add(token)
    assert found == {near_copies._name(s): set(near_copies._tokens_of(s).tolist()) for s in sets.values()}


def test_filters_keep_every_similar_pair():
    rng = np.random.default_rng(1)
    for size in (1, 3, 9, 40, 700, 5000):
        a = np.unique(rng.integers(-(2**63), 2**63, size))
        b = np.unique(np.append(a[len(a) // 9 :], rng.integers(-(2**63), 2**63, len(a) // 9)))
        both, n = len(np.intersect1d(a, b)), np.array([len(a), len(b)])
        if 9 * both >= 4 * n.sum():
            sketch = np.stack([near_copies._sketch(a), near_copies._sketch(b)])
            assert near_copies._alike(sketch, n, np.array([0]), np.array([1])).all()


def test_pairs_of_cells_in_parts(monkeypatch):
    rng = random.Random(2)
    rows = sorted((rng.randrange(6), rng.randrange(1, 30)) for _ in range(80))
    cell, n = (np.array(x) for x in zip(*rows, strict=True))
    want = {
        (i, k)
        for i in range(80)
        for k in range(i + 1, 80)
        if cell[i] == cell[k] and 4 * n[k] <= 5 * n[i]
    }
    for limit in (1, 7, 1 << 18):
        monkeypatch.setattr(near_copies, "_PAIRS_AT_ONCE", limit)
        got = [pair for x, y in near_copies._pairs(cell, n) for pair in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_rows_of_shared_shingles_do_not_follow_the_parts(spark, docs):
    line = " ".join(f"w{i}" for i in range(60))
    texts = docs([(i, f"{line} own{i} a{i} b{i} c{i}") for i in range(20)])
    for parts in (2, 50):
        dealt = near_copies._dealt(texts, parts).repartitionById(parts, "part")
        found = dealt.mapInArrow(near_copies._shared, "row long, key long").collect()
        assert len(found) == 20 * 56 and {r["key"] >> 40 for r in found} == {20}
