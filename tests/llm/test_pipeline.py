"""The registered queries against SQL, and the stages of the pipeline."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from contraluz.llm import decontaminate, oracle, packing, quality, queries, simhash, toxicity

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from check_oracle import _canonical  # noqa: E402

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_near_copies import shingles  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want, got = con.execute(oracle.oracle_sql()[name]).df(), queries.queries()[name](spark, str(FOLDER)).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and _canonical(got) == _canonical(want)


@pytest.mark.parametrize("name", ["op2_html", "op3_simhash", "op5_toxicity", "op8_hilbert"])
def test_one_row_each(spark, name):
    source = "pages" if name == "op2_html" else "documents"
    rows = spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
    assert queries.queries()[name](spark, str(FOLDER)).count() == rows


def groups(texts):
    """Smallest id of each group that 3-bit fingerprints or a 5-word similarity of 0.8 links, naively."""
    prints = {k: simhash.fingerprint_text(v) for k, v in texts.items()}
    sets = {k: shingles(v) for k, v in texts.items()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return (prints[a] ^ prints[b]).bit_count() <= 3 or sets[a] == sets[b] or 5 * both >= 4 * len(sets[a] | sets[b]) > 0

    label = dict.fromkeys(texts)
    for start in sorted(texts):
        stack = [start] if label[start] is None else []
        while stack:
            at = stack.pop()
            if label[at] is None:
                label[at] = start
                stack += [o for o in texts if label[o] is None and linked(at, o)]
    return set(label.values())


def kept_by(spark, name, texts):
    """Ids that a stage must keep of these texts."""
    table = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    if name == "simhash":
        return groups(texts)
    if name == "decontamination":
        items = [(str(r["item_id"]), r["text"]) for r in table("benchmark").collect()]
        searchers = decontaminate.build(items)
        return {k for k, v in texts.items() if not decontaminate.find(decontaminate.words_of(v), searchers)[0]}
    module = toxicity if name == "toxicity" else quality
    model = module.fit(table("documents"), table("labels"))
    inner = module.Vocabulary(model.p if name == "toxicity" else model.weights, model.settings)
    scores = {k: float(model.scores([v], inner)[0]) for k, v in texts.items()}
    if name == "toxicity":
        return {k for k, x in scores.items() if x < toxicity.REJECT}
    return {k for k, x in scores.items() if x >= quality.ACCEPT}


def test_stages_keep_what_they_must(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, dropped = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(FOLDER))
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() == kept_by(spark, name, before) and all(before[k] == v for k, v in after.items())
        dropped[name] = len(before) - len(after)
        docs, before = spark.createDataFrame(out.collect(), out.schema), after
    assert sum(n > 0 for n in dropped.values()) >= 3, dropped


def test_stages_of_odd_and_of_no_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    schema = docs.schema.add("score", "string").add("_gone", "long")
    odd = [(None, None, None, None, None, "x", 1), (1, "", None, None, 0, None, None), (1, "", None, None, 0, None, None)]
    for rows in (odd, []):
        kept = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = spark.createDataFrame(stage(spark, kept, str(FOLDER)).collect(), schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(FOLDER))
        assert packed.count() == kept.count() and (rows or kept.count() == 0)


def test_run(spark):
    out = corpus_pipeline.run(spark, str(FOLDER)).toPandas()
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= packing.CAPACITY).all()
