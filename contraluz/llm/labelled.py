"""Labelled documents for training: a bounded sample, never the held-out rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    number = F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8"))
    return F.coalesce(F.pmod(number, F.lit(folds)), F.lit(0))


@dataclass(frozen=True)
class Sample:
    """``each``: rows per label at most; longer texts than ``max_chars`` are not trained on."""

    each: int = 2000
    max_chars: int = 200_000


def labelled_texts(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    may_learn: Column,
    sample: Sample,
    id_column: str = "doc_id",
    text: str = "text",
) -> tuple[list[str], np.ndarray]:
    """Texts and labels to fit on: of each label the rows that come first by a hash of their id.

    ``may_learn`` is a condition on the id column of ``labels``. Rows without id, label or text don't
    teach. What reaches the driver is bounded by the sample, whatever the corpus.
    """
    known = labels.where(may_learn & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label")
    )
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(sample.each)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.where(F.col(text).isNotNull() & (F.length(text) <= sample.max_chars)).select(
        F.col(id_column).alias("_doc"), F.col(text).alias("_text")
    )
    joined = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))  # the bounded sample
    rows = joined.orderBy("_id", "_label", F.xxhash64("_text")).limit(2 * sample.each).toPandas()
    return rows["_text"].tolist(), rows["_label"].to_numpy(np.int64)
