"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role share a block; the pieces are
concatenated with array functions. A block looks like

    <|im_start|>role\\ntext<|im_sep|>text of the role's next turn<|im_end|>\\n

Inside texts and roles a backslash becomes two, and ``<|`` becomes ``<\\|``; a line feed in a role becomes ``<\\n>``.
Neither can then be taken for a mark, and ``unescape`` restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and segments: array of (text, loss), which concatenated give formatted.

    Loss is true for exactly the escaped texts of ``loss_role``, not for marks. Turns go by turn, then role, then text,
    so ties and repeated rows have one order; repeated rows stay. A null turn comes first; null role and text are empty.
    A null conv_id is a conversation of its own. An empty table gives no rows. Other columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(turn: Column, i: Column) -> Column:
        before = F.get(F.col("turns"), i - 1)["role"]
        same = (i > 0) & (before == turn["role"])
        mark = F.when(same, F.lit(SEPARATOR)).otherwise(F.concat(F.when(i > 0, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), escape_role(turn["role"]), F.lit("\n")))
        return F.array(F.struct(mark.alias("text"), F.lit(False).alias("loss")), F.struct(escape(turn["text"]).alias("text"), (turn["role"] == loss_role).alias("loss")))

    ending = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
    segments = chats.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), ending).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns, as array of (role, text), read back from the formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.substr(block, F.instr(block, "\n") + F.lit(1))
        body = F.left(body, F.length(body) - F.lit(len(END) + 1))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, all read back from the output: number of turns, hash of role and text lines, size and hash of the text under the loss mask, and size of the output."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
