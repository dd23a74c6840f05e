"""Chat formatting with typed content parts (operator 6, built-in functions only).

A visitor flattens the parts of a message in order: text is escaped, an image, audio or document part
becomes a placeholder, and its reference and the number of tokens it expands to are recorded. Turns
are marked by control strings. The same strings inside texts are broken by a backslash after their
first character (one more, if there are some already), so no text can pose as markup and reading
back restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of common chat templates, and of this one.
_CONTROL = r"/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|/?INST\]|/?TOOL_CALLS\]|/?AVAILABLE_TOOLS\]"
_PLAIN = rf"([<\[])(\\*)({_CONTROL})"
_ESCAPED = rf"([<\[])\\(\\*)({_CONTROL})"

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TRAINED_ROLE = "assistant"
IMAGE_PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256

PART = "kind string, text string, ref string, width int, height int, seconds double, pages int"
PARTS = f"array<struct<{PART.replace(' ', ':').replace(',:', ',')}>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_parts(text: Column) -> Column:
    """Plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast(
        "array<struct<kind:string,text:string>>"
    )


def typed(parts: Column) -> Column:
    """Text-only parts with the fields that other kinds have."""
    return F.transform(
        parts,
        lambda p: F.struct(
            p["kind"].alias("kind"),
            p["text"].alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        ),
    )


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment stands for: patches, audio frames or pages; 1 where its size is unknown."""
    size = (
        F.when(
            part["kind"] == "image",
            F.ceil(part["width"] / IMAGE_PATCH) * F.ceil(part["height"] / IMAGE_PATCH),
        )
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_PER_SECOND))
        .when(part["kind"] == "document", part["pages"].cast("long") * TOKENS_PER_PAGE)
    )
    return F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long")


def _placeholder(part: Column) -> Column:
    """What an attachment becomes; null for a text, for a part of unknown kind and for a null part."""
    image, *others = PLACEHOLDERS
    seen = F.when(part["kind"] == image, F.lit(PLACEHOLDERS[image]))
    for kind in others:
        seen = seen.when(part["kind"] == kind, F.lit(PLACEHOLDERS[kind]))
    return seen


def flattened(parts: Column) -> Column:
    """The parts in order as one string: placeholders, and escaped runs of text between them.

    Adjacent texts are put together before they are escaped, so that no control string can arise, or
    be taken for an escaped one, where two of them meet. A part of unknown kind is its text.
    """

    def visit(seen: Column, part: Column) -> Column:
        mark = _placeholder(part)
        text = F.concat(seen["run"], F.coalesce(part["text"], F.lit("")))
        closed = F.concat(seen["done"], escape(seen["run"]), mark)
        return F.when(mark.isNull(), F.struct(seen["done"].alias("done"), text.alias("run"))).otherwise(
            F.struct(closed.alias("done"), F.lit("").alias("run"))
        )

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    return F.aggregate(parts, start, visit, lambda seen: F.concat(seen["done"], escape(seen["run"])))


def attachments(parts: Column) -> Column:
    """Kind, reference and expanded tokens of the parts that became placeholders, in order."""
    held = F.filter(parts, lambda p: p["kind"].isin(*PLACEHOLDERS))
    return F.coalesce(
        F.transform(
            held,
            lambda p: F.struct(
                p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")
            ),
        ),
        F.array(),
    )


def format_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
) -> DataFrame:
    """``(conv_id, formatted, attachments)`` of every conversation.

    Turns are ordered by number, nulls first; those with the same number by role and content, and
    repeated rows stay. Null roles, parts and texts are empty, rows without conversation id form one
    conversation of their own, an empty table gives none. Each turn is formatted before the shuffle.
    The conversation as one string is the result asked for, so its turns meet in one row; each map
    task merges what it has of a conversation first.
    """
    shown = F.concat(
        F.lit(TURN),
        escape(F.coalesce(F.col(role), F.lit(""))),
        F.lit(TEXT),
        F.coalesce(flattened(F.col(parts)), F.lit("")),
        F.lit(END),
    )
    each = turns.select(
        F.col(conversation).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            shown.alias("shown"),
            attachments(F.col(parts)).alias("attachments"),
        ).alias("t"),
    )
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.col("turns.shown"), "").alias("formatted"),
        F.flatten(F.col("turns.attachments")).alias("attachments"),
    )


def segments(formatted: Column) -> Column:
    """The turns read back from a formatted conversation.

    Each has its ``role``, its unescaped ``text``, whether the ``loss`` covers it, and ``head_chars``
    and ``text_chars``: how many characters of the output stand before its text and in it. With the
    end mark they add up to the whole output, so they also are the loss mask.
    """
    split = F.split(formatted, F.lit(END.replace("|", r"\|")), -1)
    shown = F.slice(split, F.lit(1), F.size(split) - 1)

    def read(turn: Column) -> Column:
        head, body = F.substring_index(turn, TEXT, 1), F.substring_index(turn, TEXT, -1)
        role = unescape(F.substr(head, F.lit(len(TURN) + 1)))
        return F.struct(
            role.alias("role"),
            unescape(body).alias("text"),
            (role == TRAINED_ROLE).alias("loss"),
            (F.length(head) + len(TEXT)).cast("long").alias("head_chars"),
            F.length(body).cast("long").alias("text_chars"),
        )

    return F.transform(shown, read)
