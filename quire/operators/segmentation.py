"""Sentences of blocks: the units of translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx


def sentences(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence, with its place in the block and its content id."""
    others = [c for c in rows.columns if c != text]
    plain = rows.select(*others, tx.collapse_ws(text).alias("_plain"))
    # a plain explode would work the sentences out twice, once to see that there are any
    found = plain.select(*others, F.posexplode_outer(tx.segment_plain("_plain")).alias("sent_index", "text"))
    return (
        found.where("sent_index IS NOT NULL")
        .withColumn("sent_index", F.col("sent_index").cast("bigint"))
        .withColumn("sentence_id", tx.content_id("text"))
    )


def repeated_sentences(rows: DataFrame, min_count: int = 2) -> DataFrame:
    """Sentences that stand in several places and so share one id and one translation."""
    per_deck = rows.groupBy("sentence_id", "deck_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_deck.groupBy("sentence_id")
        .agg(F.sum("_n").alias("places"), F.count(F.lit(1)).alias("decks"))
        .where(F.col("places") >= min_count)
    )
