"""Quality scores from supervised subword embeddings (operator 4).

Every word, and every character n-gram of it, has a learned vector in a hashed table. A document is
the mean of the vectors of all its words and n-grams; a softmax layer turns it into label
probabilities. Vectors and layer are trained together by stochastic gradient descent in numpy. A word
that repeats the word before it also counts as the word ``REPEATED``, as no vector of a single word
can tell a repetition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contraluz.llm.labelled import Sample, fold, labelled_texts
from contraluz.llm.subwords import ngrams, word_buckets

FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3
REPEATED = "\x03repeated"
_CACHED = 400_000
_ROWS = 128


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 10
    low: int = 1
    high: int = 3
    epochs: int = 8
    batch: int = 32
    rate: float = 0.5
    seed: int = 7
    sample: Sample = Sample(each=1500)


def words_of(text: str | None) -> list[str]:
    return (text or "").split()


def features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``(word index, bucket)``: words in the first half of the table, n-grams in the second."""
    of, bucket = ngrams(words, s.low, s.high, s.buckets)
    whole = word_buckets(words, s.buckets)
    return np.concatenate([np.arange(len(words)), of]), np.concatenate([whole, bucket + s.buckets])


class Vocabulary:
    """Words met so far, each with its sum over a table of numbers and its number of features."""

    def __init__(self, weights: np.ndarray, s: Settings) -> None:
        self.weights, self.s = weights, s
        self.place: dict[str, int] = {}
        self.score, self.count = np.zeros(1 << 14), np.zeros(1 << 14)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > _CACHED:
            self.place.clear()
            new = list(words)
        if not new:
            return
        of, bucket = features(new, self.s)
        held = len(self.place)
        while held + len(new) > len(self.score):
            self.score, self.count = np.tile(self.score, 2), np.tile(self.count, 2)
        self.place.update(zip(new, range(held, held + len(new)), strict=True))
        self.score[held : held + len(new)] = np.bincount(of, self.weights[bucket], minlength=len(new))
        self.count[held : held + len(new)] = np.bincount(of, minlength=len(new))


@dataclass(frozen=True)
class QualityModel:
    """What scoring needs: the softmax of two labels only depends on a difference of logits, which is
    linear in the mean vector, so each bucket comes down to one number."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def scores(self, texts: list[str | None], vocabulary: Vocabulary) -> np.ndarray:
        out = np.empty(len(texts))
        split = [words_of(t) for t in texts]
        known = {REPEATED}.union(*split)
        vocabulary.learn(known)
        place, again = vocabulary.place, vocabulary.place[REPEATED]
        for i, words in enumerate(split):
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            repeats = np.count_nonzero(at[1:] == at[:-1])
            total = vocabulary.score[at].sum() + repeats * vocabulary.score[again]
            count = vocabulary.count[at].sum() + repeats * vocabulary.count[again]
            out[i] = self.bias + (total / count if count else 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def _documents(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document its distinct buckets and their shares of all its features."""
    out = []
    for text in texts:
        words = words_of(text)
        words += [REPEATED for a, b in zip(words, words[1:], strict=False) if a == b]
        names, often = np.unique(np.array(words, dtype=object), return_counts=True) if words else ([], [])
        of, bucket = features(list(names), s) if len(names) else (np.zeros(0, int), np.zeros(0, int))
        often = np.asarray(often, float)
        ids, back = np.unique(bucket, return_inverse=True)
        weight = np.bincount(back, often[of], minlength=len(ids)) if len(ids) else np.zeros(0)
        out.append((ids, (weight / max(weight.sum(), 1)).astype(np.float32)))
    return out


def train(texts: list[str], labels: np.ndarray, s: Settings | None = None) -> QualityModel:
    """Fit on texts with labels 0 and 1.

    With one label only, or none, every text gets the share of label 1 (a half if there is none).
    """
    s = s or Settings()
    share = float(np.mean(labels)) if len(labels) else 0.5
    table = np.zeros((2 * s.buckets, s.dim), np.float32)
    if len(set(labels.tolist())) < 2:
        return QualityModel(np.zeros(2 * s.buckets), float(np.log((share + 1e-3) / (1 - share + 1e-3))), s)
    rng = np.random.default_rng(s.seed)
    table += rng.uniform(-1 / s.dim, 1 / s.dim, table.shape).astype(np.float32)
    layer, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    docs, steps, done = _documents(texts, s), s.epochs * len(texts), 0
    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            chosen = order[at : at + s.batch]
            rate = s.rate * (1 - done / steps)
            done += len(chosen)
            for i in chosen:
                ids, share_of = docs[i]
                mean = share_of @ table[ids] if len(ids) else np.zeros(s.dim, np.float32)
                logits = mean @ layer + bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[labels[i]] -= 1
                pull = layer @ p
                layer -= rate * np.outer(mean, p)
                bias -= 0.1 * rate * p
                # the step of a bucket follows its share; the factor undoes the thinning of the mean
                table[ids] -= (rate * 20) * np.outer(share_of, pull)
    return QualityModel((table @ (layer[:, 1] - layer[:, 0])).astype(float), float(bias[1] - bias[0]), s)


def _score_udf(model: QualityModel):
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(model.weights, model.settings)
        for texts in batches:
            for at in range(0, len(texts), _ROWS):
                part = texts.slice(at, _ROWS).to_pylist()
                yield pa.array(model.scores(part, vocabulary), pa.float64())

    return score


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> QualityModel:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    s = s or Settings()
    may_learn = fold("doc_id", FOLDS) != HELD_OUT
    return train(*labelled_texts(docs, labels, "quality", may_learn, s.sample), s)


def scored(docs: DataFrame, model: QualityModel, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text in column ``name``.

    Rows are scored where they are, in one pass. Null and empty texts get the score of a text without
    words; repeated rows the same score; an empty table stays empty.
    """
    return docs.withColumn(name, _score_udf(model)(F.col(text)))
