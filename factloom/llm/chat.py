"""Chat formatting with DataFrame expressions alone.

    <|turn|>role<|text|>text<|sep|>text of the next turn, same role<|end|>...

Adjacent turns of a role share a header; `<|sep|>` keeps them apart, so the turns
can be read back.  In roles and texts a backslash is doubled and `<|` becomes
`<\\|`; no control string can then come from a text.  The loss mask is spans of
code points of the formatted text: every assistant text, without controls.

Cases: null text and null role are empty; ties of a turn go by role, then text;
repeated rows are turns of their own; rows without conversation id form one
conversation; an empty table gives an empty result.  A conversation is one cell
of the result and must fit in memory; conversations of any number are no problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, SEP, END = "<|turn|>", "<|text|>", "<|sep|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """id, formatted string, loss array<struct<start int, length int>> (code points, from 0)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    chats = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def piece(turn: Column, i: Column) -> Column:
        turns = F.col("turns")
        opens = (i == 0) | (F.get(turns, i - 1)["role"] != turn["role"])
        closes = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != turn["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT))).otherwise(F.lit(SEP)).alias("head"),
            escape(turn["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (turn["role"] == learn).alias("learn"),
        )

    def walk(state: Column, p: Column) -> Column:
        start = state["at"] + F.char_length(p["head"])
        length = F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + F.char_length(p["tail"])).alias("at"), F.when(p["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    pieces = chats.select("id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("pieces", begin, walk, lambda s: s["spans"]).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of all turns."""

    def block(b: Column) -> Column:
        parts = F.split(b, r"<\|text\|>", 2)
        role = unescape(F.substring(F.get(parts, F.lit(0)), len(TURN) + 1, 2**31 - 1))
        return F.transform(F.split(F.get(parts, F.lit(1)), r"<\|sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|end\|>", -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def under_loss(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
