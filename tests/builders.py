"""Small block tables for the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

BLOCK_DDL = (
    "deck_id string, shard bigint, page_index bigint, block_index bigint, text string, x double, y double, w double, h double, "
    "font_pt double, is_chrome_placeholder boolean, is_title_placeholder boolean, placeholder string, mono boolean, "
    "math_only boolean, table_r int, group_depth int, page_images array<struct<x:double,y:double,w:double,h:double>>"
)


def block(text, y=0.3, x=0.1, w=0.8, h=0.1, font=0.0, **meta):
    return dict(text=text, x=x, y=y, w=w, h=h, font_pt=font, **meta)


def deck(spark, pages, deck_id="d", images=None):
    """``pages`` is a list of lists of ``block``; ``images`` maps a page to image boxes."""
    rows = []
    for p, blocks in enumerate(pages):
        for i, b in enumerate(blocks):
            rows.append((
                deck_id, p >> 12, p, i, b["text"], b["x"], b["y"], b["w"], b["h"], b["font_pt"],
                b.get("chrome"), b.get("title"), b.get("placeholder", ""), b.get("mono"), b.get("math_only"),
                b.get("table_r"), b.get("depth"), (images or {}).get(p, []),
            ))
    return spark.createDataFrame(rows, BLOCK_DDL)


def kinds(df):
    """{(page, block): kind}"""
    return {(r.page_index, r.block_index): r.kind for r in df.select("page_index", "block_index", "kind").collect()}


def texts(df, col="text"):
    return [r[0] for r in df.select(F.col(col)).collect()]
