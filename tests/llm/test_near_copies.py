"""Near copies by exact similarity against brute force, and the pipeline stages that drop them."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline
from contraluz.llm import near_copies

FOLDER = Path("/root/testdata/sf0.001")


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def naive_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = dict.fromkeys(sets)
    for start in sorted(sets):
        stack = [start] if label[start] is None else []
        while stack:
            at = stack.pop()
            if label[at] is None:
                label[at] = start
                a = sets[at]
                stack += [o for o, b in sets.items() if label[o] is None and (a == b or 5 * len(a & b) >= 4 * len(a | b))]
    return label


def test_near_copies_against_brute_force(spark, docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(12))
    base = [" ".join(rng.choice(words) for _ in range(200)) + " " + line for _ in range(8)]
    rows = list(enumerate(base))
    for n in range(90):
        near = base[n % 3].split(" ")
        for _ in range(rng.randrange(1, 9)):
            near[rng.randrange(200)] = rng.choice(words)
        rows.append((100 + n, " ".join(near)))
    rows += [(200, base[4]), (201, base[4].upper()), (300, None), (301, ""), (302, "\n"), (303, "a b c"), (304, "a b  c"), (305, "a b d")]
    rows += [(400, "a b c d e f g h i j k l m n"), (401, "a b c d e f g h i j k l"), (402, "a b c d e f g h i j k")]  # 10, 8, 7
    got = {r["id"]: r["component"] for r in near_copies.near_copies(docs([*rows, (None, base[1])])).collect()}
    want = naive_components(rows)
    assert got == want and want[401] == want[402] == 400
    kept = near_copies.one_of_each_group(docs([*rows, (None, base[1])]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", *map(str, set(want.values()))])
    assert near_copies.near_copies(docs([])).count() == 0


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")
def test_no_two_near_copies_reach_packing(spark):
    kept = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[names.index("simhash") : names.index("decontamination")]:
        kept = stage(spark, kept, str(FOLDER))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert all(component == i for i, component in naive_components(rows).items())
