"""Line dedup, Merkle manifest and tokenizer alignment against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contraluz.llm import align, line_dedup, merkle, queries

WHITE = " \t\n\x0b\x0c\r"


# line dedup


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def naive_dedup(rows, least_chars=10, least_documents=2):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(WHITE))
            if len(key) >= least_chars and i is not None:
                holders[key].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        held = [holders.get(lowered(line.strip(WHITE)), set()) for line in lines]
        kept = [
            line for line, h in zip(lines, held, strict=True)
            if i is None or len(h) < least_documents or min(h) == i
        ]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


LINES = [
    (3, "A shared line here\nown words of three\nshort\n"),
    (1, "  a SHARED line here\t\nshort\na shared line here"),
    (7, "a shared line here\r\n\n\nÀ SHARED LINE HERE"),
    (8, "à shared line here\nÀ shared line here"),  # only A-Z are lowered
    (9, "a shared line here"),
    (10, None),
    (11, ""),
    (12, "123456789\nninechars"),
    (13, "123456789\n1234567890"),
    (14, " 1234567890\n1234567890"),  # a no-break space stays
    (15, "repeated in one\nrepeated in one"),
    (16, "same id in two rows"),
    (16, "same id in two rows"),
    (16, "another\nsame id in two rows"),
    (None, "a shared line here"),
    (None, "1234567890"),
    (-5, "x\n" * 3 + "a shared line of the smallest id\n" * 2),
    (6, "a shared line of the smallest id\na shared line of the smallest id"),
]


@pytest.mark.parametrize("least_documents", [2, 3])
def test_line_dedup_against_brute_force(spark, docs, least_documents):
    got = line_dedup.dedup_lines(docs(LINES).withColumn("_places", F.lit(1)).withColumn("Lines", F.lit(2)), least_documents=least_documents)
    assert got.columns[-1] == "_lines" and "score" in got.columns
    rows = [(r["doc_id"], r["text"], r["_lines"]["n_lines"], r["_lines"]["n_dropped"]) for r in got.collect()]
    assert sorted(rows, key=str) == naive_dedup(LINES, least_documents=least_documents)


def test_line_dedup_of_long_and_random_texts(spark, docs):
    rng = random.Random(3)
    pool = [f"line number {n} of the pool" for n in range(40)] + ["x", "", "\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    rows += [(100, "\n".join(f"an own line with number {n}" for n in range(20_000))), (101, "z" * 200_000)]
    rows += [(102, rows[-2][1]), (103, "\n".join(pool * 500))]
    got = line_dedup.dedup_lines(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["text"], *r["lines"]) for r in got), key=str) == naive_dedup(rows)
    assert line_dedup.dedup_lines(docs([])).count() == 0


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def naive_tree(leaves, fan):
    """The root, and each leaf's siblings (before, after) upward."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // fan * fan : place // fan * fan + fan]
            own = place % fan
            steps[i].append(("".join(run[:own]), "".join(run[own + 1 :])))
            at[i] = place // fan
        level = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], steps


def naive_manifest(rows, fan):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0], sha("".join(map(code, row)))))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    roots, below = [], {}
    for t in names:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subroot, below[t] = naive_tree([d for _, d in trees[t]], fan)
        roots.append(subroot)
    root, above = naive_tree(roots, fan)
    out = []
    for t, subroot, upper in zip(names, roots, above, strict=True):
        for place, ((i, leaf), steps) in enumerate(zip(trees[t], below[t], strict=True)):
            out.append((t, place, leaf, subroot, root, [*steps, *upper], i))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, at int, own string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize(("fan", "digits"), [(8, 3), (2, 1), (3, 2)])
def test_manifest_against_brute_force(spark, fan, digits):
    rows = [(i * 3 % 97, f"s{i % 2}", "en", i, f"text Ä {i}\n") for i in range(70)]
    rows += [(i, None, "fr", None, None) for i in range(9)] + [(5, "", "", 0, ""), (6, None, None, None, "")]
    rows += [(None, "a", "de", 1, "x"), (None, "a", "de", 1, "x"), (4, "a", "de", 1, "y"), (4, "a", "de", 1, "x"), (4, "a", "de", 1, "x")]
    rows += [(1, "s", "É", 1, "z" * 100_000), (2, "s", "=", 1, "1:a")]
    found = merkle.manifest(made(spark, rows), FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id")}, fan, digits)
    checked = found.withColumn("fold", merkle.folded(F.col("leaf"), F.col("steps")))
    got = checked.collect()
    assert all(r["fold"] == r["root"] for r in got)
    flat = [
        (r["tree"], r["place"], r["leaf"], r["subroot"], r["root"], [(s["before"], s["after"]) for s in r["steps"]], r["doc_id"])
        for r in got
    ]
    assert sorted(flat, key=str) == naive_manifest(rows, fan)


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(made(spark, [(1, "s", "en", 1, "t")]), FIELDS, "lang", "doc_id").collect()
    assert len(one) == 1 and one[0]["steps"] == [] and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"]
    assert merkle.manifest(made(spark, []), FIELDS, "lang", "doc_id").count() == 0


def test_tampering_shows(spark, tmp_path):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(40)] + [(41, "s", "en", 1, None)]
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_manifest(spark, str(tmp_path)).collect():
        changed = r["doc_id"] != 41 and r["doc_id"] % 2 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        assert r["verified"] is (not changed) and (r["folded_root"] == r["root"]) is (not changed)


# alignment


def token_spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(table[i]), i))
        at += len(table[i])
    return out


def naive_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(queries.tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECES))
    a.encode_special_tokens = True
    alphabet = align._byte_level()
    names = {i: t for t, i in a.get_vocab().items()}
    rows, count = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a = a.encode(want.decode(), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        table_a = {i: bytes(alphabet[c] for c in names[i]) for i in ids_a}
        pieces = {i: b.id_to_piece(i) for i in ids_b}
        table_b = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for i, p in pieces.items()}
        joined = [b"".join(map(t.get, ids)) for t, ids in ((table_a, ids_a), (table_b, ids_b))]
        if not text or joined != [want, want]:
            rows.append(None)
            continue
        one, two = token_spans(ids_a, table_a), token_spans(ids_b, table_b)
        cuts = sorted({e for _, e, _ in one} & {e for _, e, _ in two})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low < e <= high) for side in (one, two)))
            low = high
        links = [(i, j) for s, e, i in one for u, v, j in two if max(s, u) < min(e, v)]
        count.update(links)
        rows.append((len(one), len(two), len(groups), links, ";".join(groups)))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
        else:
            n_a, n_b, n_groups, links, groups = row
            n_best = sum(count[p] == best[p[1]] for p in links)
            out.append((n_a, n_b, n_groups, len(links), n_best, sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest(), groups))
    return out


TEXTS = [
    "The quick brown fox jumps over the lazy dog.",
    "  leading and   several spaces\n\n\ttabs ",
    "Übergrößenträger naïve Ελληνικά русский 日本語 😀 é",
    "<|endoftext|> </s> <s> <unk> <0x41> ▁",
    "a",
    " ",
    "\x00\x01\x7f",
    None,
    "",
    "The quick brown fox jumps over the lazy dog.",
    "antidisestablishmentarianism pneumonoultramicroscopicsilicovolcanoconiosis 1234567890 3.14159",
    "na " * 700,
    "x" * 3000 + " end",
    "  ​﻿\u0085",
]


@pytest.mark.parametrize("frequent", [align.FREQUENT, 40, 0])
def test_alignment_against_brute_force(spark, docs, frequent):
    rows = list(enumerate(TEXTS)) + [(None, TEXTS[0])]
    got = align.aligned(
        docs(rows).withColumn("_row", F.lit(1)).withColumn("pair", F.lit(2)),
        queries.tokenizer_path(),
        queries.tokenizer_path(queries.PIECES),
        keep_groups=True,
        frequent=frequent,
    )
    want = naive_alignment([t for _, t in rows])
    found = sorted(((r[0], tuple(r)[1:]) for r in got.collect()), key=str)
    assert found == sorted(zip([i for i, _ in rows], want, strict=True), key=str)
    assert sum(w[0] > 0 for w in want) > 8


def test_alignment_of_no_rows(spark, docs):
    paths = queries.tokenizer_path(), queries.tokenizer_path(queries.PIECES)
    assert align.aligned(docs([]), *paths).count() == 0
    assert [tuple(r) for r in align.aligned(docs([(1, None)]), *paths).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_gallop_and_overlaps_on_random_lists():
    rng = random.Random(11)
    for _ in range(300):
        end = rng.randrange(1, 60)
        one, two = (sorted({*rng.sample(range(1, end + 1), rng.randrange(0, end + 1)), end}) for _ in "ab")
        short, long = sorted((one, two), key=len)
        assert align.gallop(short, long) == [sum(x < e for x in long) for e in short]
        left, right, last_a, last_b = align.overlaps(align.np.array(one), align.np.array(two))
        spans = [[(low, high) for low, high in zip([0, *s], s, strict=False)] for s in (one, two)]
        want = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if max(s, u) < min(e, v)]
        assert sorted(zip(left.tolist(), right.tolist(), strict=True)) == want
        both = set(one) & set(two)
        assert last_a.tolist() == [e in both for e in one] and last_b.tolist() == [e in both for e in two]


def test_counts_over_a_byte_come_in_parts():
    pairs, counts = align._stored(align.np.array([3, 9]), align.np.array([700, 2]), "<u4")
    total = Counter()
    for p, c in zip(align.np.frombuffer(pairs, "<u4").tolist(), counts, strict=True):
        total[p] += c
    assert total == {3: 700, 9: 2}
