"""Five stages that turn raw documents into packed training sequences.

Each stage works on all its predecessor kept. Models are fitted on labelled rows of the whole documents
table outside their held-out folds, never on what a stage hands on.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraluz.llm import decontaminate, near_copies, packing, quality, simhash, toxicity
from contraluz.llm.common import free_name, table
from contraluz.llm.components import connected_components
from contraluz.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the toxicity network doesn't reject (operator 5)."""
    model = toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    name = free_name("toxicity", docs.columns)
    kept = toxicity.scored(docs, model, name).where(F.col(name) < toxicity.REJECT)
    return kept.select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents the quality classifier accepts (operator 4)."""
    model = quality.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    name = free_name("quality", docs.columns)
    kept = quality.scored(docs, model, name).where(F.col(name) >= quality.ACCEPT)
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (operator 3).

    Fingerprints that differ in at most 3 bits link, and so do texts with a similarity of 0.8 or more
    over five words; a group is what either kind of link reaches.
    """
    found = simhash.near_duplicates(docs), near_copies.near_copies(docs)
    links = [f.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")) for f in found]
    gone = connected_components(links[0].unionAll(links[1])).select(F.col("a").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any benchmark passage (operator 7)."""
    name = free_name("hits", docs.columns)
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"), name=name)
    return found.where(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Places of all token pieces in sequences of at most 2048 (operator 10)."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# classifiers, fingerprints and tokenizers are beyond SQL: tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents table; each is written to the shared folder and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="contraluz-")
    base = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
