"""Lines that many documents share stay in one of them only (operator 11, built-ins only).

Lines are exploded with their places, normalised and hashed; the distinct documents of each hash are
counted; lines of a hash in too many documents are marked everywhere but in the smallest id that holds
it, and each text is put together again from the runs between its marked places.

Only 128-bit hashes, ids and places are shuffled for the count and the marks, the texts once for the
last join. The distinct count first shuffles by hash and document, so a line that a third of all
documents share is spread, and then combines before its second shuffle. The shared hashes are
written, so that their join with the lines, one row a hash on the right, is between two plain shuffles,
which adaptive execution splits where a hash is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contraluz.llm.common import ascii_lower, checkpointed, free_name

LEAST_CHARS = 10
LEAST_DOCUMENTS = 2
_WHITE = " \t\n\x0b\x0c\r"
_HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, ASCII capitals lowered."""
    return ascii_lower(F.btrim(line, F.lit(_WHITE)))


def _lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(_id, _text_hash, _pos, _h1, _h2)`` of every line whose key is long enough."""
    cut = F.posexplode(F.split(F.col("_text"), "\n", -1)).alias("_pos", "_line")
    keyed = (
        docs.where(F.col("_id").isNotNull())
        .select("_id", F.xxhash64("_text").alias("_text_hash"), cut)
        .select("_id", "_text_hash", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= least_chars)
    )
    # two hashes of 64 bits with different seeds: at 10^12 lines one alone would confuse thousands
    return keyed.select(
        "_id",
        "_text_hash",
        "_pos",
        F.xxhash64("_key").alias("_h1"),
        F.xxhash64(F.lit("second"), "_key").alias("_h2"),
    )


def shared_lines(lines: DataFrame, least_documents: int) -> DataFrame:
    """``(_h1, _h2, _first)``: hashes in enough documents, with the smallest id that holds each."""
    counted = lines.groupBy(*_HASH).agg(
        F.count_distinct("_id").alias("_n"), F.min("_id").alias("_first")
    )
    return counted.where(F.col("_n") >= least_documents).select(*_HASH, "_first")


def _without(text: Column, places: Column) -> Column:
    """The text without the lines at the given ascending places: the runs between them, joined."""

    def runs(lines: Column) -> Column:
        def run(k: Column) -> Column:
            start = F.coalesce(F.get(places, k - 1) + 1, F.lit(0))
            end = F.coalesce(F.get(places, k), F.size(lines))
            return F.slice(lines, start + 1, end - start)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), run)), "\n")

    # an array of one, so that the text is split once and not for each run
    return F.transform(F.array(F.split(text, "\n", -1)), runs)[0]


def dedup_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    name: str = "lines",
) -> DataFrame:
    """``docs`` with their texts cut down, and ``name``: a struct of ``n_lines`` and ``n_dropped``.

    A key (see ``line_key``) of at least ``least_chars`` code points in at least ``least_documents``
    distinct ids loses its lines in all documents but that of the smallest id, where all of them stay,
    repeats included. Null texts are empty, and an empty text is one empty line. Rows that repeat an
    id are parts of one document. Rows without an id are counted nowhere and lose nothing. A text
    that loses all lines is empty. An empty table gives no rows. A column that has the name already
    gets the new one underscored (``free_name``); others go through untouched.
    """
    counts = free_name(name, docs.columns)
    lines = _lines(
        docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")),
        least_chars,
    )
    marked = (
        lines.join(checkpointed(shared_lines(lines, least_documents)), _HASH)
        .where(F.col("_id") != F.col("_first"))
        .groupBy("_id", "_text_hash")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_places"))
    )
    whole, places = F.coalesce(docs[text], F.lit("")), marked["_places"]
    same = (docs[id_column] == marked["_id"]) & (F.xxhash64(whole) == marked["_text_hash"])
    dropped = F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long")
    kept = F.when(places.isNull(), whole).otherwise(_without(whole, places))
    n_lines = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [kept.alias(text) if c == text else docs[c] for c in docs.columns]
    return docs.join(marked, same, "left").select(
        *columns, F.struct(n_lines.alias("n_lines"), dropped.alias("n_dropped")).alias(counts)
    )
