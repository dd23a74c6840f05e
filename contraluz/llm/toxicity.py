"""Toxicity scores from a bidirectional gated recurrent network (operator 5).

A word's input is a learned hashed word vector beside the mean of the learned vectors of its character
n-grams. Two gated recurrent layers read the text, one in each direction; for every window of ``width``
words, whatever word it starts at, attention pools the states of its words and a logistic layer scores
the result. A document scores as its worst window. Labels are known for documents only, so training
alternates: the network chooses the windows that stand for each document, and is fitted to them, each
read with some words around it. Forward and backward passes, and the optimiser, are numpy.

Each word is projected once. Runs over a text are short and side by side: a segment of words in either
direction, begun ``around`` words early as in training, so that a word's states depend on what stands near
it and not on how long the text is. A window's score is a ratio of two sums
over its words; running sums give those of all overlapping windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.common import in_chunks
from contraluz.llm.labelled import Sample, fold, labelled_texts
from contraluz.llm.subwords import ngrams, word_buckets

FOLDS, HELD_OUT = 3, 1
REJECT = 0.7
RARE = "\x03rare"
_CACHED = 150_000
_ROWS = 256
_BYTES = 1 << 17  # of the texts that are scored together, where these are several
_LEARNED = 1 << 12  # words whose n-grams are held together
# ASCII that is no letter or digit ends a word; capitals are lowered before
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    width: int = 16
    draw: int = 12  # distance of the windows that training draws from at first
    around: int = 16  # words that training reads before and after a window
    segment: int = 24  # words whose states one run gives, after as many words as training reads first
    word_buckets: int = 1 << 15
    char_buckets: int = 1 << 16
    word_dim: int = 8
    char_dim: int = 8
    hidden: int = 8
    low: int = 3
    high: int = 5
    warm_up: int = 120  # batches of windows that share their document's label
    rounds: int = 3  # of choosing windows anew
    steps: int = 50  # batches in a round
    batch: int = 96
    rate: float = 0.01
    table_rate: float = 1.0
    seed: int = 11
    sample: Sample = Sample(each=1000)


def words_of(text: str | None) -> list[str]:
    raw = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD)
    return raw.decode("utf-8", "surrogatepass").split(" ") if raw.strip() else []


def window_starts(n: int, width: int, stride: int = 1) -> np.ndarray:
    """Starts of windows over ``n`` words, the last one flush with the end; a short text has one."""
    if n <= width:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - width, stride), n - width)


def _shapes(s: Settings) -> dict[str, tuple[int, ...]]:
    d, h = s.word_dim + s.char_dim, s.hidden
    return {
        "words": (s.word_buckets, s.word_dim),
        "chars": (s.char_buckets, s.char_dim),
        "in_f": (d, 3 * h),
        "in_b": (d, 3 * h),
        "bias_f": (3 * h,),
        "bias_b": (3 * h,),
        "rec_f": (h, 3 * h),
        "rec_b": (h, 3 * h),
        "attend": (2 * h,),
        "out": (2 * h,),
        "shift": (1,),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Inputs:
    """Distinct words as places in the two embedding tables."""

    def __init__(self, words: list[str], s: Settings, rare: frozenset[str] = frozenset()) -> None:
        named = [RARE if w in rare else w for w in words] if rare else words
        self.word = word_buckets(named, s.word_buckets)
        of, self.gram = ngrams(words, s.low, s.high, s.char_buckets)
        order = np.argsort(of, kind="stable")
        self.of, self.gram = of[order], self.gram[order]
        self.count = np.maximum(np.bincount(self.of, minlength=len(words)), 1)
        self.starts = np.searchsorted(self.of, np.arange(len(words) + 1))

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        chars = np.stack(
            [np.bincount(self.of, c[self.gram], minlength=len(self.word)) for c in p["chars"].T], 1
        )
        return np.concatenate([p["words"][self.word], chars / self.count[:, None]], 1).astype(np.float32)


def _direction(x: np.ndarray, mask: np.ndarray | None, rec: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction: ``x`` is (steps, windows, 3 * hidden), already projected."""
    steps, n, wide = x.shape
    h = wide // 3
    state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
    for t in range(steps):
        g = state @ rec
        gates = _sigmoid(x[t, :, : 2 * h] + g[:, : 2 * h])
        r, z = gates[:, :h], gates[:, h:]
        new = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
        after = new + z * (state - new)
        if mask is not None:
            after = np.where(mask[t][:, None], after, state)
        if keep is not None:
            keep.append((state, r, z, new, g[:, 2 * h :]))
        state = out[t] = after
    return out


def _pool(out: np.ndarray, pool: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights, pooled states and logits of windows; ``out`` is (steps, windows, 2 hidden)."""
    e = np.where(pool, out @ p["attend"], -30.0)
    a = np.exp(e - e.max(axis=0)) * pool
    a /= np.maximum(a.sum(axis=0), 1e-30)
    pooled = np.einsum("tn,tnh->nh", a, out)
    return a, pooled, pooled @ p["out"] + p["shift"][0]


def forward(
    xf: np.ndarray, xb: np.ndarray, mask: np.ndarray, pool: np.ndarray, p: dict, keep: dict | None = None
):
    """Logits of windows from projected inputs (steps, windows, 3 * hidden).

    ``mask`` tells the steps that are words, ``pool`` those that belong to the window.
    """
    kf, kb = ([], []) if keep is not None else (None, None)
    of = _direction(xf, mask, p["rec_f"], kf)
    ob = _direction(xb[::-1], mask[::-1], p["rec_b"], kb)[::-1]
    out = np.concatenate([of, ob], axis=2)
    a, pooled, logits = _pool(out, pool, p)
    if keep is not None:
        keep.update(out=out, a=a, pooled=pooled, f=kf, b=kb)
    return logits


def _read(
    x: np.ndarray, at: np.ndarray, begin: np.ndarray, count: np.ndarray, warm: np.ndarray, way: int, rec: np.ndarray
) -> np.ndarray:
    """States of all words in one direction; lanes side by side, the longest first.

    A lane reads ``count`` words from ``begin`` in direction ``way``; the states of the first ``warm`` of
    them belong to another lane. ``x`` has projected words, ``at`` the word of each place.
    """
    order = np.argsort(-count, kind="stable")
    begin, count, warm = begin[order], count[order], warm[order]
    h = x.shape[1] // 3
    out, state = np.empty((len(at), h), np.float32), np.zeros((len(begin), h), np.float32)
    late = int(warm.max()) if len(warm) else 0
    live = np.searchsorted(-count, -np.arange(int(count[0]) if len(count) else 0), side="left")
    for t, n in enumerate(live.tolist()):
        places = begin[:n] + way * t
        now, before = x[at[places]], state[:n]
        g = before @ rec
        gates = _sigmoid(now[:, : 2 * h] + g[:, : 2 * h])
        new = np.tanh(now[:, 2 * h :] + gates[:, :h] * g[:, 2 * h :])
        after = new + gates[:, h:] * (before - new)
        state[:n] = after
        if t < late:
            own = warm[:n] <= t
            out[places[own]] = after[own]
        else:
            out[places] = after
    return out


def _direction_back(grad: np.ndarray, mask: np.ndarray, rec: np.ndarray, kept: list):
    """Gradients of one direction: of the projected inputs, and of the recurrent matrix."""
    steps, n, h = grad.shape
    back, d_rec = np.zeros((n, h), np.float32), np.zeros_like(rec)
    d_x = np.empty((steps, n, 3 * h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, r, z, new, g = kept[t]
        total = grad[t] + back
        live = total * mask[t][:, None]
        d_new = live * (1 - z) * (1 - new * new)
        d_z = live * (state - new) * z * (1 - z)
        d_r = d_new * g * r * (1 - r)
        d_g = np.concatenate([d_r, d_z, d_new * r], 1)
        d_x[t, :, :h], d_x[t, :, h : 2 * h], d_x[t, :, 2 * h :] = d_r, d_z, d_new
        d_rec += state.T @ d_g
        back = live * z + (total - live) + d_g @ rec.T
    return d_x, d_rec


def gradients(
    places: np.ndarray, mask: np.ndarray, pool: np.ndarray, target: np.ndarray, inputs: Inputs, p: dict, s: Settings
):
    """Gradients of the mean logistic loss on windows; ``places`` (steps, windows) index ``inputs``."""
    e = inputs.vectors(p)
    xf, xb = (e @ p["in_f"] + p["bias_f"])[places], (e @ p["in_b"] + p["bias_b"])[places]
    keep: dict = {}
    logits = forward(xf, xb, mask, pool, p, keep)
    n, h = len(target), s.hidden
    d = ((_sigmoid(logits) - target) / n).astype(np.float32)
    g = {"out": keep["pooled"].T @ d, "shift": np.array([d.sum()])}
    d_pooled = d[:, None] * p["out"]
    d_a = np.einsum("nh,tnh->tn", d_pooled, keep["out"])
    d_e = keep["a"] * (d_a - (keep["a"] * d_a).sum(axis=0))
    g["attend"] = np.einsum("tn,tnh->h", d_e, keep["out"])
    d_out = keep["a"][:, :, None] * d_pooled + d_e[:, :, None] * p["attend"]
    df, g["rec_f"] = _direction_back(d_out[:, :, :h], mask, p["rec_f"], keep["f"])
    db, g["rec_b"] = _direction_back(d_out[::-1, :, h:], mask[::-1], p["rec_b"], keep["b"])
    flat = places.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(len(e)))
    d_vec = np.zeros_like(e)
    for name, grad in (("f", df), ("b", db[::-1])):
        rows = np.concatenate([grad.reshape(len(flat), -1)[order], np.zeros((1, 3 * h), np.float32)])
        by_word = np.add.reduceat(rows, starts, axis=0)
        by_word[np.diff(np.append(starts, len(flat))) == 0] = 0
        g[f"in_{name}"], g[f"bias_{name}"] = e.T @ by_word, by_word.sum(axis=0)
        d_vec += by_word @ p[f"in_{name}"].T
    share = d_vec[:, s.word_dim :] / inputs.count[:, None]
    g["words"] = (inputs.word, d_vec[:, : s.word_dim])
    g["chars"] = (inputs.gram, share[inputs.of])
    return g, logits


class Optimiser:
    """Adam for the network, plain steps for the embedding tables.

    With plain steps a word moves as far as its windows agree, so a word that is often in windows of
    one label outruns those that are in a few by chance; Adam would move both alike.
    """

    def __init__(self, p: dict, rate: float, table_rate: float) -> None:
        self.p, self.rate, self.table_rate, self.t = p, rate, table_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict) -> None:
        self.t += 1
        for k, grad in g.items():
            if isinstance(grad, tuple):
                rows, back = np.unique(grad[0], return_inverse=True)
                total = np.stack([np.bincount(back, c, minlength=len(rows)) for c in grad[1].T], 1)
                self.p[k][rows] -= self.table_rate * np.clip(total, -0.02, 0.02)
                continue
            m = self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            v = self.v[k] = 0.99 * self.v[k] + 0.01 * grad * grad
            m, v = m / (1 - 0.9**self.t), v / (1 - 0.99**self.t)
            self.p[k] -= self.rate * m / (np.sqrt(v) + 1e-8)


class Vocabulary:
    """Words met so far with their inputs already projected for both directions."""

    def __init__(self, p: dict, s: Settings) -> None:
        self.p, self.s = p, s
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.f = np.zeros((1 << 14, 3 * self.s.hidden), np.float32)
        self.b = self.f.copy()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > _CACHED:
            self.clear()
            new = list(words)
        if not new:
            return
        held = len(self.place)
        if held + len(new) > len(self.f):
            size = max(held + len(new), min(2 * len(self.f), _CACHED))
            more = np.zeros((size - len(self.f), self.f.shape[1]), np.float32)
            self.f, self.b = np.concatenate([self.f, more]), np.concatenate([self.b, more])
        self.place.update(zip(new, range(held, held + len(new)), strict=True))
        for part in in_chunks(new, _LEARNED):
            e = Inputs(part, self.s).vectors(self.p)
            self.f[held : held + len(part)] = e @ self.p["in_f"] + self.p["bias_f"]
            self.b[held : held + len(part)] = e @ self.p["in_b"] + self.p["bias_b"]
            held += len(part)


@dataclass(frozen=True)
class ToxicityModel:
    p: dict
    settings: Settings
    scale: float = 1.0
    offset: float = 0.0

    def states(self, at: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Of every word, how much attention it gets and what its states add to a logit.

        ``at`` holds the words of all texts, one text after the other.
        """
        s, p, h = self.settings, self.p, self.settings.hidden
        ends = np.cumsum(sizes)
        pieces = -(-sizes // s.segment)
        text = np.repeat(np.arange(len(sizes)), pieces)
        first = ends[text] - sizes[text]
        low = first + (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * s.segment
        high = np.minimum(low + s.segment, ends[text])
        before, after = np.minimum(s.around, low - first), np.minimum(s.around, ends[text] - high)
        f = _read(vocabulary.f, at, low - before, high - low + before, before, 1, p["rec_f"])
        b = _read(vocabulary.b, at, high + after - 1, high - low + after, after, -1, p["rec_b"])
        parts = [f @ p[k][:h] + b @ p[k][h:] for k in ("attend", "out")]
        return parts[0].astype(np.float64), parts[1].astype(np.float64)

    def windows(self, texts: list[str | None], vocabulary: Vocabulary):
        """Logit of every window of the texts, the text each belongs to, and where it starts."""
        s = self.settings
        split = [[w for w in words_of(t) if w] for t in texts]
        vocabulary.learn(set().union(*split))
        place = vocabulary.place
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        attention, value = self.states(at, sizes, vocabulary)
        weight = np.exp(np.clip(attention, -30, 30))
        total = np.append(0, np.cumsum(weight))
        worth = np.append(0, np.cumsum(weight * value))
        many = np.maximum(sizes - s.width + 1, 1)
        owner = np.repeat(np.arange(len(texts)), many)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        low = (np.cumsum(sizes) - sizes)[owner] + first
        high = low + np.minimum(s.width, sizes[owner])
        share = (worth[high] - worth[low]) / np.maximum(total[high] - total[low], 1e-30)
        return share + float(self.p["shift"][0]), owner, first

    def scores(self, texts: list[str | None], vocabulary: Vocabulary) -> np.ndarray:
        logits, owner, _ = self.windows(texts, vocabulary)
        worst = np.full(len(texts), -np.inf, np.float64)
        np.maximum.at(worst, owner, logits)
        return 1 / (1 + np.exp(-np.clip(self.scale * worst + self.offset, -60, 60)))


def _constant(share: float, s: Settings) -> ToxicityModel:
    p = {k: np.zeros(v, np.float32) for k, v in _shapes(s).items()}
    return ToxicityModel(p, s, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))


def train(texts: list[str], labels: np.ndarray, s: Settings | None = None) -> ToxicityModel:
    """Fit on texts with labels 0 and 1; with one label only, every text gets the share of label 1.

    A fifth of the texts is kept for setting the scale of the final scores.
    """
    s = s or Settings()
    if len(set(labels.tolist())) < 2:
        return _constant(float(np.mean(labels)) if len(labels) else 0.5, s)
    rng = np.random.default_rng(s.seed)
    p = {}
    for k, shape in _shapes(s).items():
        size = 0.05 if k in ("words", "chars") else 0.3 if k[:4] != "bias" and k != "shift" else 0
        p[k] = rng.normal(0, size, shape).astype(np.float32)
    model = ToxicityModel(p, s)
    kept = rng.random(len(texts)) < 0.2
    if len(set(labels[kept].tolist())) < 2 or len(set(labels[~kept].tolist())) < 2:
        kept[:] = False
    learn = np.flatnonzero(~kept)
    split = [[w for w in words_of(t) if w] for t in texts]
    rare = _rare_words([split[i] for i in learn])
    _lean(p, [split[i] for i in learn], labels[learn], rare, s)
    optimiser = Optimiser(p, s.rate, s.table_rate)
    for chosen, steps in _curriculum(model, texts, split, labels, learn, rng):
        for part in _batches(chosen, labels, steps, s.batch, rng):
            begin = [max(0, a - s.around) for _, a in part]
            words = [split[i][b : a + s.width + s.around] for (i, a), b in zip(part, begin, strict=True)]
            distinct = sorted(set().union(*words))
            if not distinct:
                continue
            index = {w: i for i, w in enumerate(distinct)}
            steps_in = s.width + 2 * s.around
            places = np.zeros((steps_in, len(part)), np.int64)
            mask, pool = np.zeros(places.shape, bool), np.zeros(places.shape, bool)
            for j, (row, (_, a), b) in enumerate(zip(words, part, begin, strict=True)):
                places[: len(row), j] = [index[w] for w in row]
                mask[: len(row), j] = True
                pool[a - b : min(len(row), a - b + s.width), j] = True
            target = labels[[i for i, _ in part]].astype(np.float32)
            g, _ = gradients(places, mask, pool, target, Inputs(distinct, s, rare), p, s)
            optimiser.step(g)
    return _calibrated(model, texts, labels, np.flatnonzero(kept) if kept.any() else learn)


def _lean(p: dict, split: list[list[str]], labels: np.ndarray, rare: frozenset[str], s: Settings) -> None:
    """Start the first number of each vector at how strongly the texts that have it lean to a label.

    Labels of whole texts say little about a window; this is the part of it that needs no training:
    the signed root of the likelihood ratio beyond what chance explains, bounded.
    """
    texts = np.bincount(labels, minlength=2).astype(float)
    counts = {k: np.zeros((len(p[k]), 2)) for k in ("words", "chars")}
    for words, label in zip(split, labels, strict=True):
        if words:
            held = Inputs(list(set(words)), s, rare)
            counts["words"][np.unique(held.word), label] += 1
            counts["chars"][np.unique(held.gram), label] += 1
    for k, n in counts.items():
        def part(n: np.ndarray) -> np.ndarray:
            expected = n.sum(1, keepdims=True) * texts / texts.sum()
            return (n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9))).sum(1)

        ratio = np.sqrt(np.maximum(2 * (part(n) + part(texts - n)), 0))
        side = np.sign(n[:, 1] * texts[0] - n[:, 0] * texts[1])
        # among so many vectors, a ratio up to about 3.5 comes by chance
        p[k][:, 0] = np.clip((ratio - 3.5) / 2, 0, 2) * side
    p["words"][word_buckets([RARE], s.word_buckets), 0] = 0


def _rare_words(split: list[list[str]]) -> frozenset[str]:
    """Words of a single training text: their own vectors could only be learned by heart."""
    seen = Counter(w for words in split for w in set(words))
    return frozenset(w for w, n in seen.items() if n < 2)


def _batches(chosen: list, labels: np.ndarray, steps: int, size: int, rng) -> Iterator[list]:
    """Batches with as many windows of either label, drawn over and over."""
    sides = [[w for w in chosen if labels[w[0]] == y] for y in (0, 1)]
    for _ in range(steps):
        yield [side[i] for side in sides for i in rng.integers(0, len(side), size // 2)]


def _curriculum(model, texts, split, labels, learn, rng) -> Iterator[tuple[list, int]]:
    """Windows to draw from and how often: at first all, then those that stand for their texts."""
    s = model.settings
    yield [
        (i, int(a)) for i in learn for a in window_starts(len(split[i]), s.width, s.draw)
    ], s.warm_up
    for _ in range(s.rounds):
        chosen, vocabulary = [], Vocabulary(model.p, s)
        for part in in_chunks(learn.tolist(), _ROWS):
            logits, owner, _ = model.windows([texts[i] for i in part], vocabulary)
            for j, i in enumerate(part):
                own = slice(*np.searchsorted(owner, [j, j + 1]))
                worst = _apart(logits[own], s.width, 1 if labels[i] else 3)
                chosen += [(i, a) for a in worst]
                if not labels[i]:
                    chosen.append((i, int(rng.integers(0, own.stop - own.start))))
        yield chosen, s.steps


def _apart(logits: np.ndarray, width: int, count: int) -> list[int]:
    """Starts of the ``count`` highest windows that don't overlap."""
    left, found = logits.copy(), []
    while len(found) < count and np.isfinite(top := left.max()):
        a = int(np.flatnonzero(left == top)[0])
        found.append(a)
        left[max(0, a - width + 1) : a + width] = -np.inf
    return found


def _calibrated(model: ToxicityModel, texts: list[str], labels: np.ndarray, rows: np.ndarray) -> ToxicityModel:
    """Logistic fit of scale and offset to whole texts that the network wasn't trained on."""
    vocabulary, worst = Vocabulary(model.p, model.settings), []
    for part in in_chunks(rows.tolist(), _ROWS):
        logits, owner, _ = model.windows([texts[i] for i in part], vocabulary)
        top = np.full(len(part), -np.inf)
        np.maximum.at(top, owner, logits)
        worst.append(top)
    x, y = np.concatenate(worst), labels[rows].astype(float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    fit = np.array([1.0, 0.0])
    columns, pull = np.stack([x, np.ones(len(x))], 1), np.array([0.004, 1e-4])
    for _ in range(60):  # Newton's method, damped by bounding each step
        share = 1 / (1 + np.exp(-np.clip(columns @ fit, -60, 60)))
        slope = columns.T @ ((share - y) * weight) / len(x) + pull * (fit - [1.0, 0.0])
        bend = (columns * (weight * share * (1 - share))[:, None]).T @ columns / len(x) + np.diag(pull)
        fit -= np.clip(np.linalg.solve(bend, slope), -0.5, 0.5)
    scale, offset = fit
    return ToxicityModel(model.p, model.settings, max(float(scale), 0.1), float(offset))


def _parts(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in order, a few at a time: up to ``_ROWS`` and ``_BYTES``, and a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto, at = np.append(0, np.cumsum(sizes, dtype=np.int64)), 0
    while at < len(texts):
        stop = int(np.searchsorted(upto, upto[at] + _BYTES, side="right")) - 1
        stop = min(max(stop, at + 1), at + _ROWS)
        yield texts.slice(at, stop - at).to_pylist()
        at = stop


def _score_udf(model: ToxicityModel):
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(model.p, model.settings)
        for texts in batches:
            for part in _parts(texts):
                yield pa.array(model.scores(part, vocabulary), pa.float64())

    return score


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> ToxicityModel:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    s = s or Settings()
    may_learn = fold("doc_id", FOLDS) != HELD_OUT
    return train(*labelled_texts(docs, labels, "toxic", may_learn, s.sample), s)


def scored(docs: DataFrame, model: ToxicityModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the toxicity of each whole text in column ``name``.

    Rows are scored where they are, in one pass. Null and empty texts have one window without words;
    repeated rows get the same score; an empty table stays empty. A very long text is read in segments,
    so it takes time and memory in proportion to its words.
    """
    return docs.withColumn(name, _score_udf(model)(F.col(text)))
