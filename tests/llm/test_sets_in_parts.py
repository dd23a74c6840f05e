"""What the pipeline's workers hold at once: sets of a few texts, scores of a few rows."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from contraluz.llm import near_copies, quality


def long_texts(count, words):
    rng = random.Random(4)
    known = [f"w{i}" for i in range(3000)]
    return [" ".join(rng.choices(known, k=words)) for _ in range(count)]


def test_sets_of_a_large_batch_are_never_held_at_once(spark):
    texts = [None, "", *long_texts(1500, 600)]
    want = [near_copies.shingle_set(t) for t in texts]
    size = sum(s.nbytes for s in want)
    for udf, name in ((near_copies._names, "n"), (near_copies._sets, "shingles")):
        tracemalloc.start()
        rows = sum(len(part) for part in udf.func(iter([pa.array(texts)])))
        assert tracemalloc.get_traced_memory()[1] < size / 4
        tracemalloc.stop()
        got = [r[name] for part in udf.func(iter([pa.array(texts)])) for r in part.to_pylist()]
        assert rows == len(texts)
        assert got == [len(s) if name == "n" else s.tolist() for s in want]


def test_scores_are_handed_on_in_parts_and_unchanged(spark, docs):
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.normal(size=1 << 16), 0.1, quality.Settings())
    texts = [None, "", *long_texts(300, 40)]
    parts = [len(p) for p in quality._score_udf(model).func(iter([pa.array(texts)]))]
    assert sum(parts) == len(texts) and max(parts) <= quality._ROWS
    want = model.scores(texts, quality.Vocabulary(model.weights, model.settings))
    rows = quality.scored(docs(list(enumerate(texts))), model, "points").collect()
    assert np.allclose([r["points"] for r in sorted(rows, key=lambda r: r["doc_id"])], want)
