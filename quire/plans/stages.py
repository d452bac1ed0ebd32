"""The standing pipeline from source tables to classified blocks, sentences and their memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire import session
from quire.operators import classify as cl
from quire.operators import segmentation as sg
from quire.sources import derived, views


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return cl.classified_blocks(views.blocks(spark, sf), views.deck_sizes(spark, sf))


#: What sentences, titles, lines and contexts take of a block.
READ = [*views.PAGE, "block_index", "doc_id", "kind", "has_math", "text"]


def written_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """What is read of classified blocks, written once for work that looks at them more than once."""
    return session.written(classified(spark, sf).select(*READ), "blocks")


def sentences_of(classified_blocks: DataFrame) -> DataFrame:
    return sg.sentences(classified_blocks.select(*READ))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences_of(classified(spark, sf))


def written_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The same, written to the shared folder once, for work that reads them more than once."""
    return session.written(sentences(spark, sf), "sentences")


def written_units(sentences: DataFrame) -> DataFrame:
    """Units to translate, fixed before any model is asked: a unit must not get another number,
    or be paid for again, because a lost executor made Spark work it out anew."""
    return session.written(derived.pending(sentences), "units")
