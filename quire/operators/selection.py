"""Selections of sentences: screen order, ranges, copied text, page ranges, shape groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import session
from quire.functions import text as tx
from quire.plans import scale
from quire.sources import files
from quire.sources.views import PAGE

UNIT = ["deck_id", "page_index", "block_index", "sent_index"]
BAND = 256
# Fixed value: positions of a part of copied text. Readers know parts by their number, so it is no shard.
PART = 4096


def unit_key() -> Column:
    """Where a sentence is. Its id will not do: the same text has the same id everywhere."""
    return F.concat_ws("|", "page_index", "block_index", "sent_index")


def screen_order(sentences: DataFrame) -> DataFrame:
    """Selectable sentences with their ``position`` in the deck as shown on screen, from 0.

    Titles and body come first on a page, then captions and fragments; code and furniture are
    absent. Sentences are ranked on their page and the counts of the pages before are added, so
    no task orders a whole deck.
    """
    rank = F.when(F.col("kind").isin("title", "body"), 0).when(F.col("kind").isin("caption", "fragment"), 1)
    shown = sentences.withColumn("_flow", rank).where("_flow IS NOT NULL")
    on_page = Window.partitionBy(*PAGE).orderBy("_flow", "block_index", "sent_index")
    counts = shown.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_n"))
    before = scale.sharded_running_total(counts, ["deck_id"], "page_index", "_n", "_before").drop("_n")
    return (
        shown.withColumn("_at", F.row_number().over(on_page) - 1)
        .join(before.hint("merge"), PAGE)  # a row a page: never copied whole to every task
        .withColumn("position", F.col("_before") + F.col("_at"))
        .withColumn("key", unit_key())
        .drop("_at", "_before", "_flow")
    )


def select_units(units: DataFrame, selection: DataFrame) -> DataFrame:
    """The chosen units; ``selection`` is (selection_id, deck_id, key). Order is ``position``."""
    return units.join(selection, ["deck_id", "key"])


def select_range(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every key between two keys, both included, in either direction.

    ``ranges`` is (range_id, deck_id, from_key, to_key). If either key is unknown only the second
    is selected. Positions are cut into bands and a range is joined to the bands it touches: an
    equality join instead of a comparison with all units of the deck. Units are as many as the deck has
    sentences, however small their files are, so they are never copied whole to the driver or a task.
    """
    at = units.select("deck_id", "key", "position").hint("merge")
    ends = (
        ranges.join(at.withColumnsRenamed({"key": "from_key", "position": "_a"}), ["deck_id", "from_key"], "left")
        .join(at.withColumnsRenamed({"key": "to_key", "position": "_b"}), ["deck_id", "to_key"], "left")
    ).withColumn("_known", F.col("_a").isNotNull() & F.col("_b").isNotNull())
    ends = session.written(ends, "range_ends")
    lone = ends.where(~F.col("_known")).select("range_id", "deck_id", F.col("to_key").alias("key"))
    shift = BAND.bit_length() - 1
    bands = (
        ends.where("_known")
        .select("range_id", "deck_id", F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi"))
        .withColumn("_band", F.explode(F.sequence(F.shiftright("_lo", shift), F.shiftright("_hi", shift))))
    )
    placed = at.withColumn("_band", F.shiftright("position", shift))
    inside = bands.join(placed, ["deck_id", "_band"]).where(F.col("position").between(F.col("_lo"), F.col("_hi")))
    return inside.select("range_id", "deck_id", "key").unionByName(lone)


def copied_paragraphs(chosen: DataFrame) -> DataFrame:
    """(selection_id, position, source, target): selected neighbours rejoined into paragraphs, each at the
    position of its first sentence.

    A paragraph ends with its block or page, or at a gap in the selection, so it never leaves a block, and
    neighbours are looked for there: a selection of a whole deck is as many groups as it has blocks.
    Source sentences are joined with a space, translations with nothing.
    """
    w = Window.partitionBy("selection_id", *UNIT[:3]).orderBy("sent_index")
    # sentences in a row keep their distance from the row's number
    island = F.col("sent_index") - F.row_number().over(w)

    def joined(value: Column, by: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("position", value.alias("t")))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), by)

    target = F.when(F.coalesce(F.col("translation"), F.lit("")) != "", tx.strip("translation"))
    return chosen.withColumn("_island", island).groupBy("selection_id", *UNIT[:3], "_island").agg(
        F.min("position").alias("position"), joined(tx.strip("text"), " ").alias("source"), joined(target, "").alias("target")
    ).select("selection_id", "position", "source", "target")


def _laid_out(order: str, value: Column) -> Column:
    parts = F.array_sort(F.collect_list(F.when(value != "", F.struct(order, value.alias("t")))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")


def copy_parts(chosen: DataFrame, span: int = PART) -> DataFrame:
    """(selection_id, part, source, target, both): the copied text of a selection of any size in ordered
    parts of at most ``span`` positions, paragraphs with a blank line between. The parts that are not
    empty, in order and with a blank line between, are the whole text."""
    paragraphs = copied_paragraphs(chosen)
    both = F.when(F.col("target") != "", F.concat("source", F.lit("\n"), "target")).otherwise(F.col("source"))
    return paragraphs.groupBy("selection_id", scale.shard_of("position", span).alias("part")).agg(
        _laid_out("position", F.col("source")).alias("source"), _laid_out("position", F.col("target")).alias("target"),
        _laid_out("position", both).alias("both"),
    )


def copy_text(chosen: DataFrame) -> DataFrame:
    """Selected sentences as one text for each selection, in the three ways of :func:`copy_parts`. The row
    holds the whole text; larger selections are better left in parts, or written by :func:`save_copied`."""
    texts = [_laid_out("part", F.col(c)).alias(c) for c in ("source", "target", "both")]
    return copy_parts(chosen).groupBy("selection_id").agg(*texts)


def save_copied(parts: DataFrame, folder: str, mode: str = "both") -> None:
    """Parts as text files ``<selection>/part-<number>.txt`` below ``folder``; put together in the order of
    their names they are the copied text."""
    name = F.concat(F.url_encode(F.col("selection_id").cast("string")), F.lit("/part-"), F.lpad(F.col("part").cast("string"), 19, "0"), F.lit(".txt"))
    files.write_decks(parts.where(F.col(mode) != "").select(name.alias("path"), F.concat(mode, F.lit("\n\n")).alias("text")), folder)


def page_ranges(pages: str | Column) -> Column:
    """A set of 0-based pages as a reader would write them: ``3、5–8、12``; a run of two is spelled out."""
    col = F.col(pages) if isinstance(pages, str) else pages
    a = F.array_sort(F.array_distinct(col))
    starts = F.filter(a, lambda p, i: (i == 0) | (F.get(a, i - 1) != p - 1))
    ends = F.filter(a, lambda p, i: F.coalesce(F.get(a, i + 1) != p + 1, F.lit(True)))

    def written(s: Column, e: Column) -> Column:
        first, last = (s + 1).cast("string"), (e + 1).cast("string")
        return F.when(s == e, first).otherwise(
            F.concat(first, F.when(e == s + 1, F.lit("、")).otherwise(F.lit("–")), last)
        )

    return F.array_join(F.zip_with(starts, ends, written), "、")


def shape_groups(blocks: DataFrame) -> DataFrame:
    """Consecutive blocks of one shape, with the shape, the first block and the number of blocks."""
    w = Window.partitionBy(*PAGE).orderBy("block_index")
    shape = F.coalesce("shape_id", tx.content_id("text"))
    marked = blocks.withColumn("_shape", shape).withColumn(
        "_new", F.coalesce((F.lag("_shape").over(w) != F.col("_shape")).cast("int"), F.lit(1))
    )
    numbered = marked.withColumn("group_index", F.sum("_new").over(w))
    return numbered.groupBy(*PAGE, "group_index").agg(
        F.min("_shape").alias("shape"), F.min("block_index").alias("first_block"), F.count(F.lit(1)).alias("blocks")
    )
