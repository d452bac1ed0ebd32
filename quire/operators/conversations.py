"""Saved conversations: summaries, titles, appending, editing, message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.plans import scale

# Fixed value: the title of a conversation without a question.
DEFAULT_TITLE = "新对话"


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.left(text, F.lit(most))


def titles(turns: DataFrame, most: int | None = None) -> DataFrame:
    """A conversation is named after its first user message that is not empty, whole or cut to
    ``most`` characters."""
    text = tx.strip("text")
    asked = (F.col("role") == "user") & (text != "")
    first = F.min_by(F.when(asked, _cut(text, most)), F.when(asked, F.col("turn")))
    return turns.groupBy("conv_id").agg(F.coalesce(first, F.lit(DEFAULT_TITLE)).alias("title"))


def summaries(turns: DataFrame, most: int | None = None) -> DataFrame:
    """Title, first and last time, and number of messages, in one pass. ``turns`` has ``at``."""
    text = tx.strip("text")
    asked = (F.col("role") == "user") & (text != "")
    first = F.min_by(F.when(asked, _cut(text, most)), F.when(asked, F.col("turn")))
    return turns.groupBy("conv_id").agg(
        F.coalesce(first, F.lit(DEFAULT_TITLE)).alias("title"), F.min("at").alias("created"),
        F.max("at").alias("updated"), F.count(F.lit(1)).alias("count"),
    )


def append(turns: DataFrame, fresh: DataFrame) -> DataFrame:
    """Add messages to the end of their conversations; one not known is created.

    Both tables are (conv_id, turn, role, text); the result is renumbered from 0. The fresh ones
    are moved behind the last known turn first, so the order inside each table is kept.
    """
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    moved = scale.salted_join(fresh, last, ["conv_id"], "turn").withColumn(
        "turn", F.coalesce(F.col("_last") + 1, F.lit(0)) + F.col("turn")
    )
    every = turns.select("conv_id", "turn", "role", "text").unionByName(moved.select("conv_id", "turn", "role", "text"))
    ranked = scale.sharded_rank(every, ["conv_id"], "turn", "position", start=0)
    return ranked.select("conv_id", F.col("position").alias("turn"), "role", "text")


def edit(summary: DataFrame, renames: DataFrame, deletes: DataFrame, most: int | None = None) -> DataFrame:
    """Rename (blank gives the default title; cut to ``most`` characters where given) and delete conversations."""
    cut = _cut(tx.strip("new_title"), most)
    new = renames.select("conv_id", F.when(cut == "", DEFAULT_TITLE).otherwise(cut).alias("_new"))
    return (
        summary.join(deletes.select("conv_id"), "conv_id", "left_anti")
        .join(new, "conv_id", "left")
        .withColumn("title", F.coalesce("_new", "title"))
        .drop("_new")
    )


def message_text(content: str | Column) -> Column:
    """The text parts of a structured message, joined with a space."""
    col = F.col(content) if isinstance(content, str) else content
    parts = F.transform(F.filter(col, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return tx.strip(F.array_join(parts, " "))
