"""Classifiers, page extraction, chat format and licence scan."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from contraluz.llm import chat, html_blocks, licence, quality, toxicity
from contraluz.llm.labelled import Sample, fold, labelled_texts

FOLDER = Path("/root/testdata/sf0.01")
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "su", "vo", "pe")]


def invented(n, seed=1):
    """Texts whose label 1 shows in a few words of one stem."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "grobul" + rng.choice(["a", "en", "ist", "or", "um"])
        out.append((" ".join(words), int(i % 3 == 0)))
    return [t for t, _ in out], np.array([y for _, y in out])


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    ones = labels == 1
    return (order[ones].mean() - (ones.sum() - 1) / 2) / (~ones).sum()


def test_toxicity_generalises_to_new_word_forms():
    s = toxicity.Settings(warm_up=60, rounds=2, steps=20)
    model = toxicity.train(*invented(240), s)
    texts, labels = invented(120, seed=2)
    texts = [t.replace("grobulum", "grobulesk") for t in texts]
    scores = model.scores(texts, toxicity.Vocabulary(model.p, s))
    assert auc(scores, labels) > 0.97
    late = " ".join(WORDS * 200) + " grobulist grobulen"
    far, empty, null = model.scores([late, "", None], toxicity.Vocabulary(model.p, s))
    assert far > 0.5 and 0 <= empty == null <= 1


def test_windows_cover_the_text():
    for n in (0, 1, 24, 25, 42, 43, 1000):
        starts = toxicity.window_starts(n, 24, 18)
        covered = {i for a in starts for i in range(a, a + 24)}
        assert covered >= set(range(n)) and (n <= 24 or max(starts) + 24 == n)
        assert all(b - a <= 18 for a, b in zip(starts, starts[1:]))


def test_network_gradients():
    s = toxicity.Settings(width=5, hidden=3, word_dim=2, char_dim=2, word_buckets=16, char_buckets=16)
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.5, v) for k, v in toxicity._shapes(s).items()}
    inputs = toxicity.Inputs(["ab", "cde", "f", "xy"], s)
    places, mask = rng.integers(0, 4, (5, 3)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    pool = mask.copy()
    pool[0, 0] = pool[3:, 2] = False
    target = np.array([1.0, 0.0, 1.0])
    found, _ = toxicity.gradients(places, mask, pool, target, inputs, p, s)

    def loss():
        e = inputs.vectors(p).astype(float)
        x = [(e @ p[f"in_{d}"] + p[f"bias_{d}"])[places] for d in "fb"]
        logits = toxicity.forward(*x, mask, pool, p)
        return np.mean(np.log1p(np.exp(logits)) - target * logits)

    for k in ("rec_f", "rec_b", "in_f", "in_b", "bias_f", "bias_b", "attend", "out", "shift"):
        at = tuple(0 for _ in p[k].shape)
        was, step = p[k][at], 1e-2
        p[k][at] = was + step
        high = loss()
        p[k][at] = was - step
        assert (high - loss()) / (2 * step) == pytest.approx(found[k][at], rel=0.02, abs=2e-5)
        p[k][at] = was


def naive_windows(model, text):
    """Logits of all windows of one text: both networks word by word in every segment, begun some words
    early, then attention window by window."""
    s, p = model.settings, model.p
    words = [w for w in toxicity.words_of(text) if w]
    if not words:
        return [float(p["shift"][0])]
    e = toxicity.Inputs(words, s).vectors(p).astype(float)
    h, sides = s.hidden, []
    for way in ("f", "b"):
        x = e @ p[f"in_{way}"] + p[f"bias_{way}"]
        found = np.zeros((len(words), h))
        for low in range(0, len(words), s.segment):
            high = min(low + s.segment, len(words))
            before, after = max(0, low - s.around), min(len(words), high + s.around)
            state = np.zeros(h)
            for t in range(before, high) if way == "f" else range(after - 1, low - 1, -1):
                g = state @ p[f"rec_{way}"]
                r, z = 1 / (1 + np.exp(-(x[t, :h] + g[:h]))), 1 / (1 + np.exp(-(x[t, h : 2 * h] + g[h : 2 * h])))
                new = np.tanh(x[t, 2 * h :] + r * g[2 * h :])
                state = (1 - z) * new + z * state
                if low <= t < high:
                    found[t] = state
        sides.append(found)
    states = np.concatenate(sides, 1)
    logits = []
    for a in range(max(1, len(words) - s.width + 1)):
        part = states[a : a + s.width]
        weight = np.exp(part @ p["attend"])
        logits.append(float((weight / weight.sum()) @ part @ p["out"] + p["shift"][0]))
    return logits


def test_every_window_as_a_naive_scorer_has_it():
    s = toxicity.Settings(width=6, hidden=4, word_dim=4, char_dim=4, word_buckets=64, char_buckets=64)
    rng = np.random.default_rng(3)
    p = {k: rng.normal(0, 0.6, v).astype(np.float32) for k, v in toxicity._shapes(s).items()}
    model = toxicity.ToxicityModel(p, s)
    pick = random.Random(2)
    texts = [" ".join(pick.choice(WORDS) for _ in range(n)) for n in (1, 5, 6, 7, 40, 250)] + ["", None, "...", "ka"]
    logits, owner, first = model.windows(texts, toxicity.Vocabulary(p, s))
    for i, text in enumerate(texts):
        want = naive_windows(model, text)
        assert first[owner == i].tolist() == list(range(len(want)))
        assert logits[owner == i] == pytest.approx(want, abs=1e-4)
    scores = model.scores(texts, toxicity.Vocabulary(p, s))
    assert scores == pytest.approx([1 / (1 + np.exp(-max(naive_windows(model, t)))) for t in texts], abs=1e-4)


def test_toxicity_wherever_a_text_stands():
    model = toxicity.train(*invented(240), toxicity.Settings(warm_up=60, rounds=2, steps=20))
    texts, labels = invented(60, seed=5)
    vocabulary = toxicity.Vocabulary(model.p, model.settings)
    plain = model.scores(texts, vocabulary)
    rng = random.Random(7)
    neutral = [rng.choice(WORDS) for _ in range(1400)]
    for before in [*range(24), 100, 255, 256, 1300]:
        moved = model.scores([" ".join([*neutral[:before], t]) for t in texts], vocabulary)
        ones = labels == 1
        assert ((moved[ones] >= toxicity.REJECT) == (plain[ones] >= toxicity.REJECT)).all()
        assert np.abs(moved - plain)[ones].mean() < 0.05


def test_quality_model():
    texts, labels = invented(200)
    texts += ["the the the the again again again again"] * 20
    labels = np.append(1 - labels, [0] * 20)
    model = quality.train(texts, labels)
    held, truth = invented(90, seed=3)
    scores = model.scores(held, quality.Vocabulary(model.weights, model.settings))
    assert auc(scores, 1 - truth) > 0.95
    empty, null = model.scores(["", None], quality.Vocabulary(model.weights, model.settings))
    assert 0 <= empty == null <= 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_label_or_none(module):
    for labels, want in (([], 0.5), ([1, 1], 1.0)):
        model = module.train(["a b"] * len(labels), np.array(labels, dtype=int))
        vocabulary = (
            quality.Vocabulary(model.weights, model.settings)
            if module is quality
            else toxicity.Vocabulary(model.p, model.settings)
        )
        assert model.scores(["x y", None], vocabulary) == pytest.approx([want, want], abs=0.01)


def test_held_out_rows_never_teach(spark, docs):
    rows = [(i, f"text {i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    texts, y = labelled_texts(docs(rows), labels, "quality", fold("doc_id", 5) != 0, Sample(each=30))
    import zlib

    ids = [int(t.split()[1]) for t in texts]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and len(ids) == 60
    assert [i % 2 for i in ids] == y.tolist()


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")
def test_quality_on_held_out_documents(spark):
    from contraluz.llm.queries import op4_quality

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = op4_quality(spark, str(FOLDER)).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.95
    assert op4_quality(spark, str(FOLDER)).count() == 1000


def test_scores_keep_columns_and_repeats(spark, docs):
    model = quality.train(*invented(60))
    frame = quality.scored(docs([(1, "x"), (1, "x"), (2, None)]), model, "s")
    got = frame.collect()
    assert len(got) == 3 and frame.columns[:-1] == docs([]).columns
    assert got[0]["s"] == got[1]["s"] and quality.scored(docs([]), model, "s").count() == 0


PAGE = """<html><head><title>No</title><script>var a="</p><p>no";</script></head><body class="sidebar">
<header><p>Site name</p></header><nav><ul><li><a href=x>Home</a><li>More</ul></nav>
<div class="cookie-notice"><p>We use many cookies on this site, please accept all of them now</p></div>
<main><article><header><h1>The   title</h1></header><p>First <b>bo</b>ld &amp; &lt;b&gt;<br>second&nbsp;line
<p>Short.<aside>Aside text</aside><form><p>Sign up here</p></form><!-- <p>no</p> -->
<p><a href=y>link only</a></p><div hidden><p>no</p></div>
<section id="comments"><article class="comment"><p>Reader text that is long enough to count</p></article></section>
</article></main><div class="ad">Buy this</div><footer>&copy; us <p>more footer"""


def test_page():
    tree = html_blocks.default_tree()
    assert " ".join(html_blocks.main_blocks(PAGE, tree)) == "The title First bold & <b> second line Short. link only"
    assert html_blocks.main_blocks(None, tree) == html_blocks.main_blocks("", tree) == []
    plain = "".join(f"<div>{'word ' * 40}</div>" for _ in range(3)) + "<ul><li><a>Home</a><li><a>Back</a></ul>"
    assert len(html_blocks.main_blocks(plain, tree)) == 3
    deep = "<div>" * 20_000 + "<article>x y" + "</div>" * 20_000
    assert html_blocks.main_blocks(deep, tree) == ["x y"]
    for odd in ("<", "<a href='x", "<p", "<!--", "<script>", "a < b & c", "</p></div>"):
        html_blocks.main_blocks(odd, tree)


PROSE = "".join(f"<p>{'word ' * 30}</p>" for _ in range(3))
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/b'>Our news</a></li></ul>"


def test_layout_words_are_no_parts_of_a_page():
    tree = html_blocks.default_tree()
    for name in ("has-sidebar", "content no-sidebar", "legal-text", "page-with-ads", "search-results story", "side-by-side"):
        assert len(html_blocks.main_blocks(f'<div class="{name}">{PROSE}</div>', tree)) == 3, name
    for name in ("cookie-bar", "ad-slot", "nav-list", "newsletter_box", "social-links", "main-sidebar", "comments-area", "comment-list", "ad", "ads top", "sidebar-widget"):
        assert len(html_blocks.main_blocks(f'<div class="{name}">{PROSE}</div><div>{PROSE}</div>', tree)) == 3, name


def test_neighbours_decide_about_short_blocks():
    tree = html_blocks.default_tree()
    text = "<p>" + "w " * 30 + "</p>"
    assert len(html_blocks.main_blocks(f"<div>{text}<ul><li>one two</li><li>three</li><li>four five</li></ul>{text}</div>", tree)) == 5
    short = "<body><div><h1>Title here</h1><p>One short one.</p><p>Two short.</p><p>And the third.</p></div></body>"
    assert html_blocks.main_blocks(short, tree) == ["Title here", "One short one.", "Two short.", "And the third."]
    assert html_blocks.main_blocks(f"<div>{MENU}<h2>Intro</h2>{text}</div>", tree)[0] == "Intro"
    assert html_blocks.main_blocks("<div><a>Home</a><p>or</p><a>News</a><p>or</p><a>Shop</a></div>", tree) == []


def test_blocks_of_pages_without_an_article():
    """Block F1 on pages of several kinds, made of parts whose role is known."""
    tree, rng = html_blocks.default_tree(), random.Random(6)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    right = found = both = 0
    for kind in range(60):
        parts = [(MENU, []), (f"<div class='cookie-bar'>{words(12)}</div>", [])]
        body = []
        if kind % 3:
            head = words(rng.randrange(2, 8))
            body.append((f"<h1>{head}</h1>", [head]))
        for _ in range(rng.randrange(2, 7)):
            lead = words(rng.randrange(8, 60))
            body.append((f"<p>{lead}</p>" if kind % 2 else f"<div>{lead}</div>", [lead]))
            if rng.random() < 0.3:
                items = [words(rng.randrange(1, 5)) for _ in range(3)]
                body.append(("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", items))
        shell = "<div class='page-content has-sidebar'>{}</div>" if kind % 2 else "<section>{}</section>"
        parts.append((shell.format("".join(h for h, _ in body)), [t for _, ts in body for t in ts]))
        parts += [(MENU, []), (f"<div id='comments'><p>{words(20)}</p></div><footer>{words(9)}</footer>", [])]
        want = [t for _, ts in parts for t in ts]
        got = html_blocks.main_blocks("<html><body>" + "".join(h for h, _ in parts) + "</body></html>", tree)
        right += len(want)
        found += len(got)
        both += len(set(want) & set(got))
    assert 2 * both / (right + found) > 0.97


def test_tree_learns_its_table():
    tree, table = html_blocks.default_tree(), np.array(html_blocks.LABELLED)
    assert all(html_blocks.is_main(tree, tuple(r[:-1])) == bool(r[-1]) for r in table)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, "y")], "page_id long, html string, text string")
    got = html_blocks.extracted(pages).collect()
    assert len(got) == 3 and got[2]["text"] == "" and got[0]["text"] == got[1]["text"] != ""
    assert html_blocks.extracted(pages.limit(0)).count() == 0


NASTY = ["</s>", "<\\/s>", "[INST] x [/INST]", "<|end|>", "<\\\\|end|>", "<<SYS>>", "plain", "", "\\", "<</s>", "[[INST]", "<|turn|><|text|>"]


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice([*NASTY, "<", "[", "|", "s>", "/"]) for _ in range(6)) for _ in range(200)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in got)
    held = ("</s>", "[INST]", "[/INST]", "<|end|>", "<|turn|>", "<|text|>", "<<SYS>>")
    assert not any(c in r["e"] for r in got for c in held)


def test_adjacent_texts_are_one(spark):
    texts = [["a<|e", "nd|>b"], ["<\\", "|end|>"], ["<", "/s>"], ["<", None, "\\", "\\/s>"], ["[IN", "ST]"], ["<|", "turn", "|>"], [None], []]
    rows = [(i, [(("text" if n % 2 else "other"), t) for n, t in enumerate(ts)] + [None]) for i, ts in enumerate(texts)]
    rows += [(100 + i, [("text", ts[0]), ("image", "ignored"), *[("text", t) for t in ts[1:]]]) for i, ts in enumerate(texts[:6])]
    turns = spark.createDataFrame(rows, "conv_id long, parts array<struct<kind:string,text:string>>").select(
        "conv_id", F.lit(0).alias("turn"), F.lit("user").alias("role"), chat.typed(F.col("parts")).alias("parts"))
    got = {r["conv_id"]: r["t"] for r in chat.format_turns(turns).select("conv_id", chat.segments(F.col("formatted")).alias("t")).collect()}
    for i, ts in enumerate(texts):
        assert [t["text"] for t in got[i]] == ["".join(t or "" for t in ts)]
        if i + 100 in got:
            assert [t["text"] for t in got[i + 100]] == [(ts[0] or "") + "<|image|>" + "".join(t or "" for t in ts[1:])]


def test_typed_parts(spark):
    rows = [
        (1, 1, "assistant", [("text", "see <|image|>", None, None, None, None, None), ("audio", None, "a.wav", None, None, 1.5, None)], "x"),
        (1, 0, "user", [("image", None, "i.png", 57, 28, None, None), ("text", "hi", None, None, None, None, None), ("document", None, "d", None, None, None, 2), None], "x"),
        (2, None, None, None, "x"),
        (None, 0, "user", [("other", "odd", None, None, None, None, None)], "x"),
        (2, None, None, None, "x"),
    ]
    part = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}, formatted string")
    got = {r["conv_id"]: r for r in chat.format_turns(turns).select("*", chat.segments(F.col("formatted")).alias("t")).collect()}
    first = got[1]
    assert first["formatted"] == "<|turn|>user<|text|><|image|>hi<|document|><|end|><|turn|>assistant<|text|>see <\\|image|><|audio|><|end|>"
    assert [tuple(a) for a in first["attachments"]] == [("image", "i.png", 3), ("document", "d", 512), ("audio", "a.wav", 38)]
    assert [t["loss"] for t in first["t"]] == [False, True]
    whole = sum(t["head_chars"] + t["text_chars"] + len(chat.END) for t in first["t"])
    assert whole == len(first["formatted"])
    assert [(t["role"], t["text"]) for t in got[2]["t"]] == [("", ""), ("", "")] and got[None]["t"][0]["text"] == "odd"
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files, to deal in the Software without restriction"
    rows = [
        ("a/b/c/f1", "prose\nLicensed under CC BY-NC 4.0.\nmore"),
        ("a/b/c/f2", "no licence here"),
        ("a/b/f3", None),
        ("a/LICENSE", mit),
        ("a/b/LICENSE-2", "Licensed under the Apache License, Version 2.0."),
        ("a/b/LICENSE", "All rights and wrongs"),
        ("z/f4", ""),
        ("top", "x"),
        ("a/f5", "y"),
        ("a/f5", "released under the mit license"),
        (None, "Released under the MIT License."),
        ("q/LICENSES/f", "LICENSE text of nothing " * 3000),
    ]
    files = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, licence string")
    got = {r["path"]: r for r in licence.scan(files).collect()}
    assert len(got) == 10
    assert (got["a/b/c/f1"]["licence"], got["a/b/c/f1"]["origin"]) == ("CC-BY-NC-4.0", "statement")
    for path, name, place in (("a/b/c/f2", "Apache-2.0", "a/b"), ("a/b/f3", "Apache-2.0", "a/b"), ("a/b/LICENSE", "Apache-2.0", "a/b")):
        assert (got[path]["licence"], got[path]["inherited_from"]) == (name, place)
    assert (got["a/LICENSE"]["licence"], got["a/LICENSE"]["origin"]) == ("MIT", "licence file")
    assert got["a/f5"]["licence"] == "MIT" and got["a/f5"]["origin"] == "statement"
    assert got["z/f4"]["licence"] is None and got["top"]["licence"] is None
    assert licence.scan(files.limit(0)).count() == 0
