r"""Operator 3: chat formatting with relational expressions only.

Turns are collected per conversation as structs and sorted; adjacent turns of one role are
merged into one block by array functions (the places where the role changes, and a slice of the
turns for each); blocks become text by concatenation. No Python runs on the data, and the work is
linear in a conversation's turns and characters. A block reads ``<|im_start|>role\ntext<|im_end|>\n``; merged turns
are kept apart by ``<|im_sep|>``, so the rows can be read back one by one.

Escaping: inside texts and roles a backslash becomes two and ``<|`` becomes ``<\|``, so no
control string can occur in them; a line break in a role becomes ``<|im_nl|>``. Reading back
undoes this exactly. The loss mask covers the text of assistant turns: the output is a list of
segments (text, loss) whose texts make up the formatted conversation.

Scale: one shuffle on the conversation's id, after which everything is an expression over one
row. A conversation is one training sample and so one row; what is gathered in a row is that
sample's own text.

Defined results: null texts and roles count as empty; turns that share a number are ordered
by role and text, null turn numbers first; repeated rows are turns of their own; rows with a
null conversation id form one conversation; texts of any length and conversations of any number
of turns that a row can hold are formatted whole; an empty table gives no rows; extra columns are
ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEPARATE, LINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"
LOSS_ROLE = "assistant"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _replace(_replace(c, "\\", "\\\\"), "<|", "<\\|")


def unescape(c: Column) -> Column:
    return _replace(_replace(c, "<\\|", "<|"), "\\\\", "\\")


def escape_role(c: Column) -> Column:
    return _replace(escape(c), "\n", LINE)


def unescape_role(c: Column) -> Column:
    return unescape(_replace(c, LINE, "\n"))


def blocks(turns: Column) -> Column:
    """Sorted turns to blocks (role, texts): adjacent turns of one role are merged. The places where the role changes
    are found first, then each block is cut out of the turns once, so the work is linear in the turns."""
    n = F.size(turns)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))
    starts = F.filter(places, lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))

    def cut(of: Column) -> Column:
        def block(start: Column, j: Column) -> Column:
            length = F.coalesce(F.get(of, j + 1), n + 1) - start
            return F.struct(F.get(turns, start - 1)["role"].alias("role"),
                            F.transform(F.slice(turns, start, length), lambda t: t["text"]).alias("texts"))

        return F.transform(of, block)

    # the starts are bound to a variable, so that they are found once and not once for each block
    return F.get(F.transform(F.array(starts), cut), F.lit(0))


def segments(merged: Column) -> Column:
    """Blocks to (text, loss) segments in the order of the formatted text."""
    def of(block: Column) -> Column:
        loss = block["role"] == LOSS_ROLE
        head = F.struct(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")).alias("text"),
                        F.lit(False).alias("loss"))
        body = F.transform(block["texts"], lambda t, i: F.array(
            F.struct(F.when(i > 0, F.lit(SEPARATE)).otherwise(F.lit("")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t).alias("text"), loss.alias("loss"))))
        tail = F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(body), F.array(tail))

    return F.flatten(F.transform(merged, of))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>) per conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    sorted_ = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    found = sorted_.select("conv_id", blocks(F.col("turns")).alias("blocks")).select(
        "conv_id", segments(F.col("blocks")).alias("segments"))
    return found.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                        "segments")


def read_back(formatted: Column) -> Column:
    """Formatted text to its turns, an array of (role, text)."""
    def of(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.substring(block, F.locate("\n", block) + 1, F.char_length(block))
        body = F.substring_index(body, END, 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    found = F.split(formatted, r"<\|im_start\|>", -1)
    return F.flatten(F.transform(F.slice(found, F.lit(2), F.size(found) - 1), of))


def loss_text(parts: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
