"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted in the array; neighbours of one role share a block:

    <|im_start|>role
    text<|turn|>text<|im_end|>

The control strings cannot occur in what is between them: in a role or text ``&`` becomes
``&amp;`` and the ``<`` of ``<|`` becomes ``&lt;``, and a line feed in a role ``&#10;``, which
can be undone exactly. The loss mask says, turn by turn, how many characters of mark-up precede
the text, how many the text takes, and whether they count.

Rows: null text and null role are empty; a null conversation is one of its own; equal turn
numbers are ordered by role, then text, and all stay; a conversation is one row by its nature,
so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEXT = "<|im_start|>", "<|im_end|>\n", "<|turn|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) from rows (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)
        head = F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
        mark = F.when(i == 0, head).when(before["role"] == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), head))
        return F.struct(mark.alias("mark"), escape(t["text"]).alias("body"), (t["role"] == TRAINED).alias("loss"))

    pieces = sorted_.select("conv_id", F.transform("turns", piece).alias("pieces"))
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.transform(
            "pieces",
            lambda p: F.struct(F.length(p["mark"]).alias("markup"), F.length(p["body"]).alias("chars"), p["loss"].alias("loss")),
        ).alias("loss_mask"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The rows of format_chats with ``turns``, an array of (role, text, loss), read back."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        body = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substr(body, F.length(role) + 2), r"<\|turn\|>")
        plain = unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))
        return F.transform(texts, lambda x: F.struct(plain.alias("role"), unescape(x).alias("text"), F.length(x).alias("chars")))

    read = formatted.withColumn("read", F.flatten(F.transform(blocks, turns_of)))
    # the mask goes with the text it was made for, or the loss would be of other characters
    return read.withColumn(
        "turns",
        F.zip_with("read", "loss_mask", lambda t, m: F.struct(t["role"].alias("role"), t["text"].alias("text"), (m["loss"] & (m["chars"] == t["chars"])).alias("loss"))),
    ).drop("read")
