"""Hilbert shards and packing."""

from __future__ import annotations

import random
import zlib
from itertools import pairwise

import numpy as np
import pytest

from pyspark.sql import functions as F

from contraluz.llm import hilbert, packing
from contraluz.llm.queries import tokenizer_path
from contraluz.llm.ranking import global_rank


def test_long_common_prefixes_are_told_apart(spark):
    rows = [(i, f"https://example.org/a/very/long/path/source_{i % 40:03d}", "en", i) for i in range(4000)]
    rows += [(5000, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long").withColumn("text", F.lit("t"))
    placed = hilbert.shard(frame.withColumn("shard", F.lit("x")), shards=10)
    boxes = hilbert.manifest(placed)
    wanted = "https://example.org/a/very/long/path/source_003"
    few = {r["shard"] for r in hilbert.shards_to_read(boxes, "source", wanted, wanted).collect()}
    true = {r["shard"] for r in placed.where(F.col("source") == wanted).collect()}
    assert true <= few and len(few) < 6
    bounds = hilbert._string_bounds(frame, "source", 5)
    assert len(bounds) == 31 and bounds == sorted(bounds)


def test_curve_visits_every_cell_once_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert.curve_index(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(spark, docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "word " * rng.randrange(40), None, ""])) for i in range(205)]
    frame = docs([*rows, (None, "é"), (3, rows[3][1])])
    got = hilbert.shard(frame, shards=10).collect()
    assert len(got) == 207
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(v) for v in by.values()]
    assert set(by) == set(range(10)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(rows) | {None: "é"}
    for r in got:
        raw = (text[r["id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    boxes = hilbert.manifest(hilbert.shard(frame, shards=10))
    assert boxes.agg({"n_rows": "sum"}).first()[0] == 207
    assert hilbert.shard(docs([])).count() == 0
    assert {r["shard"] for r in hilbert.shard(docs([(1, "a"), (2, "b")]), shards=5).collect()} == {0, 2}


def test_global_rank(spark):
    frame = spark.createDataFrame([(x,) for x in [5, 3, None, 3, 9] * 20], "v int").repartition(3)
    ranked, total = global_rank(frame, ["v"])
    rows = sorted((r["rank"], r["v"]) for r in ranked.collect())
    assert total == 100 and [r for r, _ in rows] == list(range(100))
    values = [v for _, v in rows]
    assert values[:20] == [None] * 20 and values[20:] == sorted(values[20:])


@pytest.mark.parametrize("total", [1, 5, 2047, 2048, 2049, 4096, 5000])
def test_cut(total):
    parts = packing.cut(total)
    assert parts[0][0] == 0 and sum(n for _, n in parts) == total
    assert all(a + n == b for (a, n), (b, _) in pairwise(parts))
    assert all(n == 2048 for _, n in parts[1:]) and 0 < parts[0][1] <= 2048


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    encode, plain = packing.TokenIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    assert encode.merger is not None
    rng = random.Random(8)
    letters = "ab éß'ñ  \n\t\r12½.,!?-_'sÀ ÿĀɏ’“ \x85"
    texts = ["", "<|endoftext|> x", "日本 語", "a\x1cb", "I'll don't", "x" * 5000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        assert encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def holds_all(solution, counts, capacity):
    seen = np.zeros_like(counts)
    for p in solution.patterns:
        assert p.times > 0 and sum(p.lengths) <= capacity
        for v in p.lengths:
            seen[v] += p.times
    return (seen == counts).all() and solution.bins == sum(p.times for p in solution.patterns)


def fewest(lengths, capacity):
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_bin_completion_finds_the_fewest():
    rng = random.Random(6)
    for _ in range(40):
        lengths = sorted((rng.randrange(5, 60) for _ in range(9)), reverse=True)
        counts = np.bincount(lengths, minlength=101)
        solution = packing.solve(counts, 100)
        assert holds_all(solution, counts, 100)
        assert packing.lower_bound(counts, 100) <= fewest(lengths, 100) == solution.bins
    empty = packing.solve(np.zeros(101, int), 100)
    assert empty.bins == 0


def test_pack(spark, docs):
    rng = random.Random(3)
    rows = [(i, "token " * rng.randrange(0, 5000)) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "no id"), (3, rows[3][1])]
    frame = docs(rows)
    got = packing.pack(frame, tokenizer_path()).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    encode = packing.TokenIds(tokenizer_path())
    tokens = sum(len(encode(t or "")) // 4 + 1 for _, t in rows)
    assert sum(r["length"] for r in got) == tokens and len(by) <= -(-tokens // 2048) + 1
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    frame = docs([(1, "a b c"), (2, "d " * 3000)])
    packed = packing.pack(frame, tokenizer_path())
    ids = [x for r in packing.sequences(frame, packed, tokenizer_path()).collect() for x in r["input_ids"]]
    encode = packing.TokenIds(tokenizer_path())
    want = [*np.frombuffer(encode("a b c"), "<u4"), 0, *np.frombuffer(encode("d " * 3000), "<u4"), 0]
    assert sorted(ids) == sorted(int(x) for x in want)
