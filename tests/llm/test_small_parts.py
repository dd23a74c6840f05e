"""What Python workers hold at once: parts of a batch, never the results of all its texts."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from contraluz.llm import near_copies, packing, ranking, toxicity
from contraluz.llm.queries import tokenizer_path


def long_texts(count, words):
    rng = random.Random(3)
    known = [f"w{i}" for i in range(3000)]
    return [" ".join(rng.choices(known, k=words)) for _ in range(count)]


def peak_mb(results):
    """Most memory that handing on ``results`` took, each dropped before the next, and their rows."""
    tracemalloc.start()
    rows = sum(len(part) for part in results)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, rows


def test_pieces_of_a_large_batch_are_handed_on_in_parts(spark, docs):
    texts = [None, "", *long_texts(1000, 700)]
    pieces = packing._pieces_udf(tokenizer_path(), 2048, True).func
    list(pieces(iter([pa.array(texts[:3])])))  # the encoder is there from now on
    size = sum(len(p["ids"]) for part in pieces(iter([pa.array(texts)])) for row in part.to_pylist() for p in row)
    peak, rows = peak_mb(pieces(iter([pa.array(texts)])))
    assert rows == len(texts) and peak < size / 1e6 / 2
    assert packing._token_ids(tokenizer_path()) is packing._token_ids(tokenizer_path())
    encode = packing.TokenIds(tokenizer_path())
    cut = packing.tokenised(docs(list(enumerate(texts[:400]))), tokenizer_path(), keep_ids=True)
    got = {}
    for r in cut.orderBy("id", "piece").collect():
        got[r["id"]] = got.get(r["id"], b"") + r["ids"]
    assert got == {i: encode(t or "") + bytes(4) for i, t in enumerate(texts[:400])}


def test_toxicity_of_many_new_words_is_scored_in_parts():
    rng, s = np.random.default_rng(5), toxicity.Settings()
    p = {k: rng.normal(0, 0.3, v).astype(np.float32) for k, v in toxicity._shapes(s).items()}
    model = toxicity.ToxicityModel(p, s)
    words = iter(range(10**6))
    texts = [None, "", *(" ".join(f"word{next(words)}" for _ in range(400)) for _ in range(250)), "a b " * 90_000, "", "x"]
    score = toxicity._score_udf(model).func
    peak, rows = peak_mb(score(iter([pa.array(texts)])))
    assert rows == len(texts) and peak < 130  # 158 with all new words and 256 texts at once
    got = np.concatenate([part.to_numpy() for part in score(iter([pa.array(texts), pa.array([], pa.string())]))])
    alone = [model.scores([t], toxicity.Vocabulary(p, s))[0] for t in texts[:12] + texts[-3:]]
    assert np.allclose(np.append(got[:12], got[-3:]), alone)


def test_parts_hold_few_texts():
    texts = ["a" * 1000] * 600 + [None, "b" * (3 * toxicity._BYTES), ""]
    parts = list(toxicity._parts(pa.array(texts)))
    assert [t for part in parts for t in part] == texts and list(toxicity._parts(pa.array([], pa.string()))) == []
    assert all(len(part) <= toxicity._ROWS and (len(part) == 1 or sum(len(t or "") for t in part) <= toxicity._BYTES) for part in parts)


def test_each_set_is_made_by_one_worker(spark, docs, monkeypatch):
    plans, cells = [], near_copies._in_cells

    def kept(df, keys, by="n"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cells(df, keys, by)

    monkeypatch.setattr(near_copies, "_in_cells", kept)
    text = "one two three four five six seven eight nine ten eleven twelve"
    found = near_copies.near_copies(docs([(1, text), (2, text + "."), (3, text.upper()), (4, "other")])).collect()
    assert {r["id"]: r["component"] for r in found}[3] == 1
    assert [plan.count("EvalPython [_sets") for plan in plans if "_sets" in plan] == [1]


@pytest.mark.parametrize("rows", [0, 50])
def test_ranks_and_places_start_no_workers_for_small_tables(spark, rows, monkeypatch):
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: made.append(create(*a, **b)) or made[-1])
    pieces = spark.range(rows).selectExpr("id", "cast(0 as int) as piece", "cast(id % 7 + 1 as bigint) as length")
    ranked, total = ranking.global_rank(pieces, ["length", "id"])
    assert total == rows and sorted(r["rank"] for r in ranked.collect()) == list(range(rows))
    assert packing.pack_pieces(pieces).count() == rows
    assert len(made) == 3 and all("LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString() for df in made)
