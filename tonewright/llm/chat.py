"""Chat formatting with one training example for each assistant turn.

A turn is written ``<|start|>role<|message|>text<|end|>``. Inside role and text a backslash becomes ``\\b``, a
``<`` becomes ``\\l`` and a ``[`` becomes ``\\q``, so no control string of this or another template can occur there
and the text can be read back. Every assistant turn is an example of its own: all earlier turns of the
conversation are its context, and only the reply is under the loss mask.

An example names its context by the place in the formatted conversation where the reply begins. The
context is the stretch before it; copying it into every example would square the size of a long
conversation. ``prompts`` writes it out for those who want it. Columns only, no Python.

Nulls and odd input: a null text or role is empty; turns are in order of turn, then role, then text, nulls
first; repeated rows are turns of their own; rows with a null conversation form one conversation; a
conversation without an assistant has no example; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    text = F.replace(text, F.lit("<"), F.lit("\\l"))
    return F.replace(text, F.lit("["), F.lit("\\q"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\l"), F.lit("<"))
    text = F.replace(text, F.lit("\\q"), F.lit("["))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn: ``conv_id, ordinal, is_reply, piece, begins`` (code points before it),
    ``loss_start, loss_end`` (the reply in the formatted conversation)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE))
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = turns.withColumn("head", F.char_length(head)).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("piece", F.concat(head, F.col("body"), F.lit(END)))
    before = F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("ordinal", F.row_number().over(order)).withColumn(
        "begins", F.coalesce(before, F.lit(0)).cast("long"))
    reply = F.col("role") == ASSISTANT
    return turns.select(
        "conv_id", "ordinal", reply.alias("is_reply"), "piece", "begins",
        F.when(reply, F.col("begins") + F.col("head")).alias("loss_start"),
        F.when(reply, F.col("begins") + F.col("head") + F.char_length("body")).alias("loss_end"),
    )


def expand_targets(turns: DataFrame) -> DataFrame:
    """An example for each assistant turn: ``conv_id, example, context_turns, context_chars, target,
    loss_start, loss_end``. ``target`` is the stretch under the mask, in its escaped form."""
    number = Window.partitionBy("conv_id").orderBy("ordinal")
    size = (F.col("loss_end") - F.col("loss_start")).cast("int")
    return turns.where("is_reply").select(
        "conv_id", F.row_number().over(number).alias("example"), (F.col("ordinal") - 1).alias("context_turns"),
        F.col("loss_start").alias("context_chars"),
        F.substring(F.col("piece"), (F.col("loss_start") - F.col("begins") + 1).cast("int"), size).alias("target"),
        "loss_start", "loss_end",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted``: each conversation's turns in a row."""
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "piece")))
    return turns.groupBy("conv_id").agg(F.array_join(pieces["piece"], "").alias("formatted"))


def prompts(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples with their context written out: ``conv_id, example, prompt, target``."""
    return examples.join(formatted, "conv_id").select(
        "conv_id", "example", F.expr("substring(formatted, 1, cast(context_chars as int))").alias("prompt"), "target")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns``: roles and texts, as they were before formatting."""
    parts = F.split("formatted", r"<\|start\|>")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        body = F.substring_index(part, MESSAGE, -1)
        return F.struct(
            unescape(F.substring_index(part, MESSAGE, 1)).alias("role"),
            unescape(F.substring_index(body, END, 1)).alias("text"),
        )

    return formatted.select("conv_id", F.char_length("formatted").alias("formatted_chars"), F.transform(parts, turn).alias("turns"))


def read_loss(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """``conv_id, loss``: all text under the mask, unescaped, example after example.

    The formatted conversation is cut at its turns and their places are counted anew in it, so the mask of an
    example (``loss_start, loss_end``) is what a trainer would apply to this text: an offset that is wrong shows. Each
    turn is cut on its own, which keeps the work linear in the length of a conversation.
    """
    above = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    found = formatted.select("conv_id", F.posexplode(F.split("formatted", r"(?=<\|start\|>)")).alias("place", "part"))
    found = found.withColumn("at", F.coalesce(F.sum(F.char_length("part")).over(above), F.lit(0)))
    same = F.col("f.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("place") == F.col("context_turns"))
    first, size = (F.col("loss_start") - F.col("at") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")
    masks = examples.select("conv_id", "example", "context_turns", "loss_start", "loss_end")
    read = found.alias("f").join(masks.alias("e"), same).select(
        "e.conv_id", "example", unescape(F.substring(F.col("part"), first, size)).alias("reply"))
    replies = F.array_sort(F.collect_list(F.struct("example", "reply")))
    return read.groupBy("conv_id").agg(F.array_join(replies["reply"], "").alias("loss"))
