"""Predicates and identities of decks, pages and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import scale
from quire.sources.views import PAGE

READING = ("title", "body", "code")
FIGURE = ("caption", "fragment")
HIDDEN = ("chrome",)


def in_reading_flow(kind: str | Column = "kind") -> Column:
    return (F.col(kind) if isinstance(kind, str) else kind).isin(*READING)


def worth_translating(kind: str | Column = "kind") -> Column:
    return ~(F.col(kind) if isinstance(kind, str) else kind).isin("chrome", "code")


def flow(kind: str | Column = "kind") -> Column:
    col = F.col(kind) if isinstance(kind, str) else kind
    return F.when(col.isin(*READING), "reading").when(col.isin(*FIGURE), "figure").otherwise("hidden")


def flow_partition(classified: DataFrame) -> DataFrame:
    """Blocks with the column they are shown in and whether they go to translation."""
    return classified.withColumn("flow", flow()).withColumn("translatable", worth_translating())


def box_metrics(blocks: DataFrame) -> DataFrame:
    return (
        blocks.withColumn("cx", F.col("x") + F.col("w") / 2)
        .withColumn("cy", F.col("y") + F.col("h") / 2)
        .withColumn("area", F.col("w") * F.col("h"))
    )


def page_aspect(pages: DataFrame) -> DataFrame:
    """Width over height where both are known, else 16 to 9."""
    known = (F.col("width") > 0) & (F.col("height") > 0)
    return pages.withColumn("aspect", F.when(known, F.col("width") / F.col("height")).otherwise(F.lit(16.0) / F.lit(9.0)))


def page_title(classified: DataFrame) -> DataFrame:
    """Text of the first title block of every page, or the empty string."""
    first = F.min_by(F.when(F.col("kind") == "title", F.col("text")),
                     F.when(F.col("kind") == "title", F.col("block_index")))
    return classified.groupBy(*PAGE).agg(F.coalesce(first, F.lit("")).alias("title"))


def deck_sizes(blocks: DataFrame) -> DataFrame:
    """Pages per deck."""
    return blocks.groupBy("deck_id").agg((F.max("page_index") + 1).alias("n_pages"))


FAN_IN = 1024


def deck_fingerprint(blocks: DataFrame) -> DataFrame:
    """Content identity of a deck: the block texts in order, not the file name.

    The hash of its page hashes, 1024 at a time, level by level, for decks of every size: changed by
    any edit or reordering, and no task holds more than a page or 1024 hashes.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda b: b["text"])
    pages = blocks.groupBy(*PAGE).agg(F.array_join(texts, "").alias("_page"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_h"))), lambda p: p["_h"])
    level = pages.select("deck_id", F.col("page_index").alias("_at"), F.sha2("_page", 256).alias("_h"))
    for _ in range(4):  # 1024^4 pages
        up = F.shiftright("_at", FAN_IN.bit_length() - 1).cast("bigint")
        level = (
            level.withColumn("_up", up).groupBy("deck_id", "_up").agg(parts.alias("_parts"))
            .select("deck_id", F.col("_up").alias("_at"), F.sha2(F.array_join("_parts", ""), 256).alias("_h"))
        )
    return level.select("deck_id", F.substring("_h", 1, 16).alias("fingerprint"))
