"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contraluz.llm import (
    align,
    chat,
    decontaminate,
    hilbert,
    html_blocks,
    licence,
    line_dedup,
    merkle,
    packing,
    quality,
    simhash,
    topk,
    toxicity,
)
from contraluz.llm.common import ascii_lower, table
from contraluz.llm.labelled import fold

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree, as the table has no paths.

    Directories are source, language and hundreds of ids; every tenth document plays a licence file,
    every hundredth that of its language, every thousandth that of its source.
    """
    key, name = F.col("doc_id"), F.col("doc_id").cast("string")
    source, lang = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown"))
    block = F.expr("cast(doc_id div 100 as string)")
    licence_name = F.concat(F.lit("LICENSE-"), name)
    path = (
        F.when(key % 1000 == 0, F.concat_ws("/", source, licence_name))
        .when(key % 100 == 0, F.concat_ws("/", source, lang, licence_name))
        .when(key % 10 == 0, F.concat_ws("/", source, lang, block, licence_name))
        .otherwise(F.concat_ws("/", source, lang, block, F.concat(F.lit("page-"), name)))
    )
    return docs.where(key.isNotNull()).select(path.alias("path"), "text")


def op1_licence(spark: SparkSession, folder: str) -> DataFrame:
    found = licence.scan(document_paths(table(spark, folder, "documents")))
    return found.select(
        F.regexp_extract("path", r"-(-?\d+)$", 1).cast("long").alias("doc_id"),
        "path",
        "own_licence",
        F.round("own_score", 3).alias("own_score"),
        "licence",
        "origin",
        "inherited_from",
    )


def op2_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_blocks.extracted(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _scores(scored: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return _scores(quality.scored(docs, model), quality.FOLDS, quality.HELD_OUT, quality.ACCEPT)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return _scores(toxicity.scored(docs, model), toxicity.FOLDS, toxicity.HELD_OUT, toxicity.REJECT)


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    parts = chat.typed(chat.text_parts(F.col("text")))
    formatted = chat.format_turns(turns.unionByName(probe).withColumn("parts", parts))
    read = formatted.select("conv_id", "formatted", chat.segments(F.col("formatted")).alias("t"))
    story = F.array_join(
        F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    taught = F.array_join(F.filter("t", lambda t: t["loss"])["text"], "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(story, 256).alias("turns_sha256"),
        F.length(taught).cast("long").alias("loss_chars"),
        F.sha2(taught, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        decontaminate.items_digest("hits.items").alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op8_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    placed = hilbert.shard(table(spark, folder, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return packed.withColumnRenamed("id", "doc_id")


def op11_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_digest(*[F.col(f) for f in fields[:-1]], ascii_lower(F.col("text")))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    carry = {"doc_id": F.col("doc_id"), "changed": F.when(tampered, changed)}
    proofs = merkle.manifest(docs, fields, "lang", "doc_id", carry)
    now = F.coalesce("changed", "leaf")
    found = proofs.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
        merkle.folded(now, F.col("steps")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = align.aligned(
        table(spark, folder, "documents"), tokenizer_path(), tokenizer_path(PIECES)
    )
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_licence,
        op2_html,
        op3_simhash,
        op4_quality,
        op5_toxicity,
        op6_chat,
        op7_decontamination,
        op8_hilbert,
        op9_topk,
        op10_packing,
        op11_lines,
        op12_manifest,
        op13_alignment,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
