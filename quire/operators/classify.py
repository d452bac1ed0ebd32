"""What each block of a page is: title, body, code, caption, fragment or page furniture.

A rule needs positive evidence to take a block out of the reading flow; the default is body.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import model
from quire.plans import scale
from quire.sources.views import PAGE

# Thresholds of the rules.
FURNITURE_SHARE = 0.5
FURNITURE_MIN_PAGES = 3
FURNITURE_MAX_CHARS = 80
TITLE_MAX_Y = 0.22
TITLE_MAX_WORDS = 12
LABEL_MAX_WORDS = 4
CAPTION_MAX_WORDS = 12

REPEAT_KEY = ["deck_id", "rep_text", "rep_x", "rep_y"]


def with_features(blocks: DataFrame) -> DataFrame:
    """What the rules look at, worked out once: bare text, number of words, closing punctuation.

    No rule tells numbers of words apart that are beyond its limits, so they are counted up to there."""
    return (
        blocks.withColumn("_bare", tx.strip("text"))
        .withColumn("_words", tx.words_up_to("_bare", max(TITLE_MAX_WORDS, CAPTION_MAX_WORDS, LABEL_MAX_WORDS)))
        .withColumn("_ends", F.right("_bare", F.lit(1)).isin(*tx.SENTENCE_ENDS))
    )


def with_repeat_key(blocks: DataFrame) -> DataFrame:
    """Text and coarse position: the same words at another place are another thing."""
    bare = F.col("_bare") if "_bare" in blocks.columns else tx.strip("text")
    return (
        blocks.withColumn("rep_text", tx.fold_case(bare))
        .withColumn("rep_x", F.rint(F.col("x") * 20).cast("bigint"))
        .withColumn("rep_y", F.rint(F.col("y") * 20).cast("bigint"))
    )


def repetition_index(blocks: DataFrame) -> DataFrame:
    """On how many pages of its deck each text stands at each place.

    Pages are made distinct first, so a header on every page of a huge deck is counted by many
    tasks before its key meets in one.
    """
    per_page = with_repeat_key(blocks).select(*REPEAT_KEY, "page_index").distinct()
    return per_page.groupBy(*REPEAT_KEY).agg(F.count(F.lit(1)).alias("pages_seen"))


def furniture_by_shard(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Keys of repeated short texts that count as furniture, for every shard of a deck that holds one,
    with the pages they stand on and the number of pages of their deck.

    ``sizes`` (deck_id, n_pages) saves a pass over the blocks where it is known already. A page lies in
    one shard, so pages are counted where the blocks are, and only counts are dealt out by key: a header
    on every page of a huge deck is one row a shard.
    """
    # Folding may double the length, so texts of up to twice the limit can share a key.
    bare = blocks.withColumn("_bare", tx.strip("text")).where(F.length("_bare") <= 2 * FURNITURE_MAX_CHARS)
    # no text is missing here; said outright, as a key that might be would be worked out once more to see
    short = with_repeat_key(bare).withColumn("rep_text", F.coalesce("rep_text", F.lit("")))
    per_shard = (
        short.select(*REPEAT_KEY, "shard", "page_index").distinct()
        .groupBy(*REPEAT_KEY, "shard").agg(F.count(F.lit(1)).alias("_pages"))
    )
    seen = per_shard.withColumn("pages_seen", F.sum("_pages").over(Window.partitionBy(*REPEAT_KEY)))
    threshold = F.greatest(F.lit(FURNITURE_MIN_PAGES), F.floor(F.col("n_pages") * FURNITURE_SHARE))
    return (
        scale.salted_join(
            seen.where(F.col("pages_seen") >= FURNITURE_MIN_PAGES),
            model.deck_sizes(blocks) if sizes is None else sizes, ["deck_id"], "rep_text", how="inner",
        )
        .where(F.col("pages_seen") >= threshold)
        .select(*REPEAT_KEY, "shard", "pages_seen", "n_pages")
    )


def furniture(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Repeated short texts that count as furniture, one row a key."""
    return furniture_by_shard(blocks, sizes).drop("shard").distinct()


def with_furniture(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Featured blocks with ``pages_seen``/``n_pages`` where they are repeated furniture, else null.

    The key of a block of furniture size is one more column, and the few keys that are furniture are
    joined by deck and shard too, so blocks stay where their pages were dealt to.
    """
    rep_text = F.when(F.length("_bare") <= FURNITURE_MAX_CHARS, F.col("rep_text"))
    keyed = with_repeat_key(blocks).withColumn("rep_text", rep_text)
    found = furniture_by_shard(blocks, sizes)
    return keyed.join(found, [*REPEAT_KEY, "shard"], "left").select(*blocks.columns, "pages_seen", "n_pages")


def is_page_number() -> Column:
    return F.col("_bare").rlike(r"\A[\p{Nd}\s\x0B\x1C-\x1F\x85\p{Z}/–—-]{1,12}\z") & (
        (F.col("y") > 0.85) | (F.col("y") < 0.08)
    )


def structural_kind() -> Column:
    """The kind the file states outright, or null."""
    return F.when(F.coalesce(F.col("is_chrome_placeholder"), F.lit(False)), "chrome").when(
        F.coalesce(F.col("is_title_placeholder"), F.lit(False)), "title"
    )


# The wording of reasons, here and below; stored results are compared by them.
def structural_reason() -> Column:
    return F.when(
        F.coalesce(F.col("is_chrome_placeholder"), F.lit(False)), F.concat(F.lit("placeholder:"), F.col("placeholder"))
    ).when(F.coalesce(F.col("is_title_placeholder"), F.lit(False)), "placeholder:title")


def verbatim_kind() -> Column:
    """Code, bare equations and table cells, or null."""
    return (
        F.when(F.coalesce(F.col("mono"), F.lit(False)), "code")
        .when(F.coalesce(F.col("math_only"), F.lit(False)), "code")
        .when(F.col("table_r").isNotNull(), "fragment")
    )


def verbatim_reason() -> Column:
    return (
        F.when(F.coalesce(F.col("mono"), F.lit(False)), "monospace font")
        .when(F.coalesce(F.col("math_only"), F.lit(False)), "equation only, no prose")
        .when(F.col("table_r").isNotNull(), "table-cell")
    )


def drawing_label() -> Column:
    """Text bound to a drawing: a short label is a fragment, anything longer a caption."""
    grouped = F.coalesce(F.col("group_depth"), F.lit(0)) > 0
    label = (F.col("_words") <= LABEL_MAX_WORDS) & ~F.col("_ends")
    return F.when(grouped & label, "fragment").when(grouped, "caption")


def overlaps(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Strict overlap of the block's box with another."""
    return (
        (F.col("x") < x + w) & (x < F.col("x") + F.col("w")) & (F.col("y") < y + h) & (y < F.col("y") + F.col("h"))
    )


def caption_shape() -> Column:
    return (
        (F.coalesce(F.col("placeholder"), F.lit("")) == "")
        & (F.col("_words") <= CAPTION_MAX_WORDS)
        & ~F.col("_ends")
    )


def figure_captions(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Small unpunctuated blocks lying on an image of the same page (semi join)."""
    same_page = [F.col(f"b.{c}") == F.col(f"i.{c}") for c in PAGE]
    over = (
        (F.col("b.x") < F.col("i.img_x") + F.col("i.img_w")) & (F.col("i.img_x") < F.col("b.x") + F.col("b.w"))
        & (F.col("b.y") < F.col("i.img_y") + F.col("i.img_h")) & (F.col("i.img_y") < F.col("b.y") + F.col("b.h"))
    )
    condition = same_page[0] & same_page[1] & same_page[2] & over
    small = with_features(blocks).where(caption_shape()).select(*blocks.columns)
    return small.alias("b").join(images.alias("i"), condition, "left_semi")


def attach_images(blocks: DataFrame, images: DataFrame) -> DataFrame:
    """Give every block the image boxes of its page, as ``page_images``."""
    boxes = images.groupBy(*PAGE).agg(
        F.collect_list(F.struct(*[F.col(f"img_{c}").alias(c) for c in "xywh"])).alias("page_images")
    )
    return blocks.drop("page_images").join(boxes, PAGE, "left")


def _title_shape() -> Column:
    return (
        (F.col("y") <= TITLE_MAX_Y)
        & (F.col("_words") <= TITLE_MAX_WORDS)
        & ~F.col("_ends")
        & (F.coalesce(F.col("font_pt"), F.lit(0.0)) > 0)
        & (F.coalesce(F.col("font_pt"), F.lit(0.0)) >= F.col("_page_font"))
    )


def title_candidates(blocks: DataFrame) -> DataFrame:
    """Add ``title_fallback`` to featured blocks: short, high up, the largest text, and no title before it.

    ``_fixed`` must hold the kind given by an earlier rule, or null.
    """
    page = Window.partitionBy(*PAGE)
    sized = blocks.withColumn("_page_font", F.max(F.coalesce(F.col("font_pt"), F.lit(0.0))).over(page))
    candidate = F.coalesce(F.col("_fixed").isNull() & _title_shape(), F.lit(False))
    title = (F.col("_fixed") == "title") & F.col("_fixed").isNotNull()
    sized = sized.withColumn("_cand", candidate).withColumn("_any", (title | candidate).cast("int"))
    earlier = F.sum("_any").over(page.orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1))
    return sized.withColumn("title_fallback", F.col("_cand") & (F.coalesce(earlier, F.lit(0)) == 0)).drop(
        "_page_font", "_cand", "_any"
    )


def _early_rules() -> tuple[Column, Column]:
    """Kind and reason of the rules that come before the title rule."""
    repeated = F.col("pages_seen").isNotNull()
    kind = (
        F.when(structural_kind().isNotNull(), structural_kind())
        .when(is_page_number(), "chrome")
        .when(repeated, "chrome")
        .otherwise(verbatim_kind())
    )
    seen = F.concat(
        F.lit("repeats on "), F.col("pages_seen").cast("string"), F.lit("/"), F.col("n_pages").cast("string"),
        F.lit(" pages, same position"),
    )
    reason = (
        F.when(structural_kind().isNotNull(), structural_reason())
        .when(is_page_number(), "page-number")
        .when(repeated, seen)
        .otherwise(verbatim_reason())
    )
    return kind, reason


def classify(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Kind and reason of every block by the ordered rules; needs ``page_images``."""
    kind, reason = _early_rules()
    ruled = with_furniture(with_features(blocks), sizes).withColumn("_fixed", kind).withColumn("_why", reason)
    titled = title_candidates(ruled)
    on_image = caption_shape() & F.exists(
        F.coalesce(F.col("page_images"), F.array()), lambda i: overlaps(i["x"], i["y"], i["w"], i["h"])
    )
    late = (
        F.when(F.col("title_fallback"), _verdict("title", "top of page, short, largest text"))
        .when(drawing_label() == "fragment", _verdict("fragment", "short label inside a grouped drawing"))
        .when(drawing_label() == "caption", _verdict("caption", "text inside a grouped drawing"))
        .when(on_image, _verdict("caption", "short unpunctuated box overlapping a figure"))
        .otherwise(_verdict("body", "default"))
    )
    ruling = F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("kind"), F.col("_why").alias("reason")))
    return (
        titled.withColumn("_v", ruling.otherwise(late))
        .withColumn("kind", F.col("_v.kind")).withColumn("reason", F.col("_v.reason"))
        .select(*blocks.columns, "kind", "reason")
    )


def _verdict(kind: str, reason: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))


def rescue_pages(classified: DataFrame) -> DataFrame:
    """A page with text but nothing to read gets its inferred furniture back as body."""
    readable = F.max(model.in_reading_flow().cast("int")).over(Window.partitionBy(*PAGE))
    inferred = (F.col("kind") == "chrome") & ~F.col("reason").startswith("placeholder:")
    flagged = classified.withColumn("_readable", readable).withColumn("rescued", (F.col("_readable") == 0) & inferred)
    restored = F.lit("restored: page would otherwise have no content")
    return (
        flagged.withColumn("kind", F.when(F.col("rescued"), "body").otherwise(F.col("kind")))
        .withColumn("reason", F.when(F.col("rescued"), restored).otherwise(F.col("reason")))
        .drop("_readable")
    )


def rescue_warnings(rescued: DataFrame) -> DataFrame:
    """One warning row per page that had to be restored."""
    return rescued.where("rescued").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("restored"))


def classified_blocks(blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The whole chain: classify, then restore pages left with nothing to read."""
    return rescue_pages(classify(blocks, sizes))


def kind_histogram(classified: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """Blocks per kind and deck; ``extra`` aggregates ride on the same pass."""
    kinds = ["title", "body", "code", "caption", "fragment", "chrome"]
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    return classified.groupBy("deck_id").agg(*counts, *extra)
