"""Chat formatting with Spark expressions only.

Turn structs are collected and sorted, neighbouring turns of one role become one
block, and blocks are concatenated. The formatted text of a conversation is

    <s>role<r/>text</s>            a block of one turn
    <s>role<r/>text<m/>text</s>    a block of merged turns

``segments`` holds the same text in order as pieces with the loss flag: true on
the texts of the trained role, false on markers and all other texts.

Control strings inside roles and texts are escaped by one more backslash after
the opening bracket: ``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``;
all other characters stay. ``unescape`` takes the backslash away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of this template, and markers of common templates that a text must not smuggle in.
OPEN, ROLE_END, MERGE, CLOSE = "<s>", "<r/>", "<m/>", "</s>"
_ANGLE = r"s|/s|r/|m/|\|[a-z_]+\|"
_SQUARE = r"/?INST"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, rf"<(\\*)({_ANGLE})>", r"<$1\\$2>")
    return F.regexp_replace(c, rf"\[(\\*)({_SQUARE})\]", r"[$1\\$2]")


def unescape(c: Column) -> Column:
    c = F.regexp_replace(c, rf"<(\\*)\\({_ANGLE})>", "<$1$2>")
    return F.regexp_replace(c, rf"\[(\\*)\\({_SQUARE})\]", "[$1$2]")


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``segments`` (array of text, loss).

    Rows are ordered by turn, rows of equal turn by role and text; rows without
    a turn come first. Null roles and texts count as empty; rows without a
    conversation id form one conversation of their own. Repeated rows are turns
    of their own. Other columns are ignored.
    """
    c = lambda name: F.col(f"`{name}`")
    clean = lambda name: escape(F.coalesce(c(name), F.lit("")))
    turns = rows.select(c(conv_id).alias("conv_id"), F.struct(
        c(turn).alias("turn"), clean(role).alias("role"), clean(text).alias("text"), (c(role).eqNullSafe(F.lit(trained_role))).alias("loss"),
    ).alias("t"))
    t = F.col("turns")
    starts_block = lambda x, i: (i == 0) | ~x["role"].eqNullSafe(F.get(t, i - 1)["role"])
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.transform(t, lambda x, i: F.when(starts_block(x, i), i)), lambda i: i.isNotNull())
    blocks = F.transform(F.col("starts"), lambda s, j: F.slice(
        t, s + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.size(t)) - s
    ))
    piece = lambda v, loss: F.struct(v.alias("text"), loss.alias("loss"))
    mark = lambda v: piece(v, F.lit(False))
    segments = F.flatten(F.transform("blocks", lambda b: F.flatten(F.concat(
        F.array(F.array(mark(F.concat(F.lit(OPEN), F.get(b, 0)["role"], F.lit(ROLE_END))))),
        F.transform(b, lambda x, i: F.when(i > 0, F.array(mark(F.lit(MERGE)), piece(x["text"], x["loss"])))
                    .otherwise(F.array(piece(x["text"], x["loss"])))),
        F.array(F.array(mark(F.lit(CLOSE)))),
    ))))
    out = sorted_turns.withColumn("starts", starts).withColumn("blocks", blocks).withColumn("segments", segments)
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.select("conv_id", joined.alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) written in a formatted text, unescaped, merged turns apart again."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    turns = F.transform(blocks, lambda b: F.transform(
        F.split(F.substring_index(b, ROLE_END, -1), MERGE),
        lambda x: F.struct(
            unescape(F.substr(F.substring_index(b, ROLE_END, 1), F.lit(len(OPEN) + 1))).alias("role"), unescape(x).alias("text")
        ),
    ))
    return F.flatten(turns)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
