"""Layout of pages and paragraphs: order, geometry, fonts, lists, hyphens, tables, page breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx

# What opens a list item, and the marks of the outermost level.
BULLET = (
    r"\A[\s\x0B\x1C-\x1F\x85\p{Z}]*([•●▪◦‣⁃·]|>|[-–—](?=[\s\x0B\x1C-\x1F\x85\p{Z}])"
    r"|\(?\p{Nd}{1,2}[.)]|\(?[a-zA-Z][.)](?=[\s\x0B\x1C-\x1F\x85\p{Z}]))[\s\x0B\x1C-\x1F\x85\p{Z}]+"
)
OUTER_MARKS = ("•", "●", "·")
LIST_MARKER = (
    r"\A[\s\x0B\x1C-\x1F\x85\p{Z}]*(?:[•▪◦‣⁃*]|[-–—][\s\x0B\x1C-\x1F\x85\p{Z}]|\(?[0-9]{1,2}[.)]|\(?[a-zA-Z][.)])"
    r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
)
# Tolerances of the paragraph merge, bands of the reading order.
FONT_SLACK, GAP_ABOVE, GAP_BELOW, INDENT_SLACK = 0.6, -0.5, 0.8, 0.02
BANDS = 40


def stack_layout(blocks: DataFrame, page: Sequence[str], order: str) -> DataFrame:
    """Geometry for text that has none: blocks stacked down a nominal page."""
    w = Window.partitionBy(*page)
    i = F.row_number().over(w.orderBy(order)) - 1
    n = F.count(F.lit(1)).over(w)
    return blocks.withColumn("_i", i).withColumn("_n", n).select(
        *[c for c in blocks.columns if c not in ("x", "y", "w", "h")],
        F.lit(0.08).alias("x"), F.least(F.lit(0.95), F.col("_i") / F.col("_n") * 0.9 + 0.02).alias("y"),
        F.lit(0.84).alias("w"), (F.lit(0.9) / F.col("_n")).alias("h"),
    )


def reading_order(blocks: DataFrame, page: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rank blocks top to bottom in bands, then left to right; ``tie`` keeps the file's order."""
    band = F.rint(F.col("y") * BANDS)
    order = Window.partitionBy(*page).orderBy(band, "x", *tie)
    return blocks.withColumn("reading_rank", F.row_number().over(order).cast("bigint"))


def normalize_box(boxes: DataFrame) -> DataFrame:
    """Absolute corners to fractions of the page; a page without size counts as 1."""
    pw = F.coalesce(F.when(F.col("page_w") != 0, F.col("page_w")), F.lit(1.0))
    ph = F.coalesce(F.when(F.col("page_h") != 0, F.col("page_h")), F.lit(1.0))
    return (
        boxes.withColumn("x", F.col("x0") / pw).withColumn("y", F.col("y0") / ph)
        .withColumn("w", (F.col("x1") - F.col("x0")) / pw).withColumn("h", (F.col("y1") - F.col("y0")) / ph)
    )


def span_rollup(spans: DataFrame, block: Sequence[str]) -> DataFrame:
    """Per block the largest type size, and whether every span that names a font names a
    fixed-width one (and at least one does)."""
    named = (F.coalesce("font", F.lit("")) != "") & (tx.strip("text") != "")
    return spans.groupBy(*block).agg(
        F.round(F.max("size"), 1).alias("font_pt"),
        ((F.count_if(named) > 0) & (F.count_if(named & ~tx.is_monospace("font")) == 0)).alias("mono"),
    )


def math_flags(runs: DataFrame, block: Sequence[str]) -> DataFrame:
    """Text of a block from its runs, equations folded to plain letters, and what is in it.

    ``math_only`` by the slide rule: an equation and no letter or digit outside it.
    ``math_only_doc`` by the document rule: at least as many equation characters as letters.
    Only the text of equation runs is sent to Python; the others go as nulls.
    """
    folded = tx.fold_math(F.when(F.col("is_math"), F.col("text")))
    rows = runs.withColumn("_t", F.coalesce(folded, F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("run", "_t", "is_math")))
    grouped = rows.groupBy(*block).agg(ordered.alias("_r"))
    raw = F.array_join(F.transform("_r", lambda r: r["_t"]), "")
    prose = F.array_join(F.transform(F.filter("_r", lambda r: ~r["is_math"]), lambda r: r["_t"]), "")
    math_chars = F.aggregate("_r", F.lit(0), lambda a, r: a + F.when(r["is_math"], F.length(r["_t"])).otherwise(0))
    text = tx.collapse_ws(raw)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    has_math = F.exists("_r", lambda r: r["is_math"])
    return grouped.select(
        *block, text.alias("text"), has_math.alias("has_math"),
        (has_math & ~prose.rlike(r"[\p{L}\p{N}]")).alias("math_only"),
        ((math_chars > 0) & (math_chars >= letters)).alias("math_only_doc"),
    )


def paginate_breaks(blocks: DataFrame, document: Sequence[str], order: str) -> DataFrame:
    """Pages of a flowing document: a flagged block starts one, unless the page is still empty."""
    w = Window.partitionBy(*document).orderBy(order)
    starts = F.col("starts_page") & (F.row_number().over(w) > 1)
    return blocks.withColumn("_s", starts.cast("int")).withColumn(
        "page", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")
    ).drop("_s")


def text_coverage(pages: DataFrame) -> DataFrame:
    """Per deck: no page with text is a scan, under half partial, else fine. Needs ``has_text``."""
    counted = pages.groupBy("deck_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if("has_text").alias("with_text"))
    state = F.when(F.col("with_text") == 0, "scan").when(F.col("with_text") < F.col("pages") / 2, "partial").otherwise("ok")
    return counted.withColumn("coverage", state)


def table_cells(tables: DataFrame, grid: str = "grid") -> DataFrame:
    """A grid of texts as one row per cell that is not empty, with its row and column."""
    others = [c for c in tables.columns if c != grid]
    rows = tables.select(*others, F.posexplode(grid).alias("table_r", "_row"))
    cells = rows.select(*others, "table_r", F.posexplode("_row").alias("table_c", "_cell"))
    return cells.withColumn("text", tx.collapse_ws("_cell")).where("text <> ''").withColumn(
        "is_header", F.col("table_r") == 0
    ).drop("_cell")


def bullet_segments(lines: DataFrame, block: Sequence[str], order: str = "line_no") -> DataFrame:
    """Lines of a layout block as paragraphs and list items.

    A line that opens with a list mark starts a segment, others go on with it. A block of code or
    without any list mark stays one segment. Needs ``line`` and ``mono``.
    """
    w = Window.partitionBy(*block).orderBy(order)
    whole = Window.partitionBy(*block)
    flagged = lines.withColumn("_b", F.col("line").rlike(BULLET))
    gated = flagged.withColumn("_any", F.max("_b").over(whole) & ~F.max("mono").over(whole))
    opens = F.col("_any") & F.col("_b")
    numbered = gated.withColumn("_open", opens).withColumn("segment", F.sum(F.col("_open").cast("int")).over(w))
    mark = F.regexp_extract("line", BULLET, 1)
    body = F.when(F.col("_open"), tx.replace_all("line", BULLET)).otherwise(F.col("line"))
    parts = numbered.select(
        *block, order, "segment", "mono", "_any", F.col("_open"), F.when(F.col("_open"), mark).alias("_mark"), body.alias("_body")
    )
    ordered = F.array_sort(F.collect_list(F.struct(order, "_body")))
    grouped = parts.groupBy(*block, "segment").agg(
        F.transform(ordered, lambda r: r["_body"]).alias("_lines"), F.max("_mark").alias("_mark"), F.max("mono").alias("mono"),
        F.max("_any").alias("_any"),
    )
    code = F.btrim(F.array_join(F.transform("_lines", lambda s: F.rtrim(s)), "\n"), F.lit("\n"))
    # Only a block without list marks is running text, where broken words are repaired.
    running = tx.join_soft_hyphens(F.array_join("_lines", "\n"))
    prose = tx.collapse_ws(F.when(F.col("_any"), F.array_join("_lines", " ")).otherwise(running))
    # Text before the first mark of a list counts as an inner level, as any unknown mark does.
    outer = F.coalesce(F.col("_mark").isin(*OUTER_MARKS), F.lit(False))
    return grouped.select(
        *block, F.col("segment").cast("bigint").alias("segment"), F.when(F.col("mono"), code).otherwise(prose).alias("text"),
        F.col("_mark").isNotNull().alias("bullet"),
        F.when(~F.col("_any") | outer, 0).otherwise(1).alias("depth"), "mono",
    ).where("text <> ''")


_MERGED = (
    "array<struct<text:string,x:double,y:double,w:double,h:double,font_pt:double,mono:boolean,bullet:boolean,"
    "line_h:double,lines:int,first:bigint>>"
)


def merge_paragraphs(blocks: DataFrame, page: Sequence[str], order: str) -> DataFrame:
    """Rejoin blocks that are really lines of one paragraph.

    Every block is held against the paragraph grown so far, whose box depends on what was joined
    before, so this is a fold over the blocks of one page, in order. Only the open paragraph is
    carried and finished ones are appended; a page bounds both.
    """
    fields = ["text", "x", "y", "w", "h", "font_pt", "mono", "bullet"]
    rows = blocks.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("_b"))

    def start(b: Column) -> Column:
        return F.struct(
            *[b[f].alias(f) for f in fields], b["h"].alias("line_h"), F.lit(1).alias("lines"), b[order].cast("bigint").alias("first")
        )

    def continues(p: Column, c: Column) -> Column:
        line_h = F.when(p["line_h"] != 0, p["line_h"]).when(p["h"] != 0, p["h"]).otherwise(c["h"])
        gap = c["y"] - (p["y"] + p["h"])
        return (
            ~c["text"].rlike(LIST_MARKER) & ~p["bullet"] & ~c["bullet"] & (p["mono"] == c["mono"])
            & (F.abs(p["font_pt"] - c["font_pt"]) <= FONT_SLACK)
            & (gap >= line_h * GAP_ABOVE) & (gap <= line_h * GAP_BELOW) & (c["x"] >= p["x"] - INDENT_SLACK)
        )

    def absorbed(p: Column, c: Column) -> Column:
        broken = p["text"].endswith("-") & F.substring(c["text"], 1, 1).rlike(r"\p{Ll}")
        text = (
            F.when(p["mono"] & c["mono"], F.concat(p["text"], F.lit("\n"), c["text"]))
            .when(broken, F.concat(F.left(p["text"], F.length(p["text"]) - 1), c["text"]))
            .otherwise(F.concat(p["text"], F.lit(" "), c["text"]))
        )
        x = F.least(p["x"], c["x"])
        right = F.greatest(p["x"] + p["w"], c["x"] + c["w"])
        bottom = F.greatest(p["y"] + p["h"], c["y"] + c["h"])
        return F.struct(
            text.alias("text"), x.alias("x"), p["y"].alias("y"), (right - x).alias("w"), (bottom - p["y"]).alias("h"),
            p["font_pt"].alias("font_pt"), p["mono"].alias("mono"), p["bullet"].alias("bullet"),
            p["line_h"].alias("line_h"), (p["lines"] + 1).alias("lines"), p["first"].alias("first"),
        )

    def step(done: Column, block: Column) -> Column:
        last = F.element_at(done, -1)
        grow = (F.size(done) > 0) & continues(last, block)
        head = F.when(grow, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.concat(head, F.array(F.when(grow, absorbed(last, block)).otherwise(start(block))))

    merged = F.aggregate("_b", F.array().cast(_MERGED), lambda acc, b: F.when(F.size(acc) == 0, F.array(start(b)).cast(_MERGED)).otherwise(step(acc, b).cast(_MERGED)))
    return rows.select(*page, F.inline(merged))
