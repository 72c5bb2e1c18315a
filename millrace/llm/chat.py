"""Chat formatting as relational algebra, with Spark expressions only.

A conversation's turns are collected as structs and sorted.  Adjacent turns of
one role share a message.  The formatted text is

    <|start|> role <|text|> text (<|next|> text)* <|end|>      (without the blanks)

for each message.  Texts and roles are escaped by writing a dot after every
less-than sign, so a control string can't occur inside them, and reading them
back only removes that dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<."))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<."), F.lit("<"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, segments) per conversation.

    segments is an array of (text, loss) whose texts joined are `formatted`; loss
    is true for an assistant's text alone, so it is the loss mask.  Turns are
    ordered by turn, then role and text (nulls first); a null text or role counts
    as empty; repeated rows are turns of their own; a null conversation id is a
    conversation; an empty table gives no row.
    """
    rows = turns.select(
        turns[conv_col].alias("conv_id"),
        F.struct(
            turns[turn_col].alias("turn"),
            F.coalesce(turns[role_col], F.lit("")).alias("role"),
            F.coalesce(turns[text_col], F.lit("")).alias("text"),
        ).alias("t"),
    )
    said = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opened = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT))

    def pieces(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)
        control = F.when(i == 0, opened(t)).when(before["role"] == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), opened(t)))
        return F.array(
            F.struct(control.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
        )

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    cut = said.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), closing).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    quoted = lambda s: rf"\Q{s}\E"
    messages = F.split(formatted, quoted(END), -1)
    messages = F.slice(messages, 1, F.size(messages) - 1)

    def turns(m: Column) -> Column:
        halves = F.split(m, quoted(TEXT), 2)
        role = unescape(F.replace(F.get(halves, F.lit(0)), F.lit(START), F.lit("")))
        return F.transform(F.split(F.get(halves, F.lit(1)), quoted(NEXT), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
