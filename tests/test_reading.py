from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import context as ctx
from quire.operators import conversations as conv
from quire.operators import selection as sel

S = "deck_id string, shard bigint, page_index bigint, block_index bigint, sent_index bigint, kind string, text string, translation string"


def sentences(spark):
    """Page 0: a caption found before a body block of three sentences; page 1: one body block."""
    rows = [
        ("d", 0, 0, 0, 0, "title", "Title", "标题"), ("d", 0, 0, 1, 0, "caption", "Label", None),
        ("d", 0, 0, 2, 0, "body", "One. ", "一。"), ("d", 0, 0, 2, 1, "body", "Two.", "二。"), ("d", 0, 0, 2, 2, "body", "Three.", None),
        ("d", 0, 0, 3, 0, "code", "x = 1", None), ("d", 0, 0, 4, 0, "chrome", "Nav", None), ("d", 0, 1, 0, 0, "body", "Next.", "下。"),
    ]
    return spark.createDataFrame(rows, S)


def test_screen_order_puts_labels_after_the_text(spark):
    units = sel.screen_order(sentences(spark)).orderBy("position").collect()
    assert [(u.position, u.text) for u in units] == [(0, "Title"), (1, "One. "), (2, "Two."), (3, "Three."), (4, "Label"), (5, "Next.")]


@pytest.mark.parametrize("a,b,want", [
    ("0|2|1", "1|0|0", {"0|2|1", "0|2|2", "0|1|0", "1|0|0"}), ("1|0|0", "0|2|1", {"0|2|1", "0|2|2", "0|1|0", "1|0|0"}),
    ("0|0|0", "0|0|0", {"0|0|0"}), ("9|9|9", "0|2|1", {"0|2|1"}), ("0|0|0", "9|9|9", {"9|9|9"}),
])
def test_ranges(spark, a, b, want):
    ranges = spark.createDataFrame([(1, "d", a, b)], "range_id int, deck_id string, from_key string, to_key string")
    got = sel.select_range(sel.screen_order(sentences(spark)), ranges)
    assert {r.key for r in got.collect()} == want


def test_a_range_over_many_bands(spark):
    rows = [("d", 0, p, 0, i, "body", f"{p}-{i}", None) for p in range(40) for i in range(25)]
    units = sel.screen_order(spark.createDataFrame(rows, S))
    ranges = spark.createDataFrame([(1, "d", "1|0|3", "38|0|20")], "range_id int, deck_id string, from_key string, to_key string")
    assert sel.select_range(units, ranges).count() == (38 * 25 + 20) - (25 + 3) + 1


def test_units_of_small_files_are_not_copied_to_every_task(spark, monkeypatch):
    """A written table of millions of units may be a few MB of files; it is no table to broadcast."""
    from quire import session

    rows = [("d", 0, p, 0, i, "body", f"{p}-{i}", None) for p in range(40) for i in range(25)]
    units = session.written(sel.screen_order(spark.createDataFrame(rows, S)), "units")
    ranges = spark.createDataFrame([(1, "d", "1|0|3", "3|0|2")], "range_id int, deck_id string, from_key string, to_key string")
    plans, real = [], session.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(session, "written", noted)
    got = sel.select_range(units, real(ranges, "ranges"))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "BroadcastHashJoin" in p], plans
    assert got.count() == 50


def copied(spark, *keys):
    units = sel.screen_order(sentences(spark))
    chosen = sel.select_units(units, spark.createDataFrame([("s", "d", k) for k in keys], "selection_id string, deck_id string, key string"))
    return sel.copy_text(chosen).first()


def test_neighbours_are_one_paragraph(spark):
    got = copied(spark, "0|2|1", "0|2|0")
    assert (got.source, got.target, got.both) == ("One. Two.", "一。二。", "One. Two.\n一。二。")


def test_a_gap_makes_two_paragraphs_and_a_missing_translation_is_left_out(spark):
    got = copied(spark, "0|2|0", "0|2|2", "1|0|0")
    assert got.source == "One.\n\nThree.\n\nNext."
    assert got.target == "一。\n\n下。"
    assert got.both == "One.\n一。\n\nThree.\n\nNext.\n下。"


def test_a_part_of_copied_text_is_4096_positions(spark):
    """Whatever number of rows the rankings put into a task."""
    rows = [("d", 0, p, 0, i, "body", f"{p}-{i}", None) for p in range(90) for i in range(50)]
    chosen = sel.screen_order(spark.createDataFrame(rows, S)).where("sent_index <> 49").withColumn("selection_id", F.col("deck_id"))
    got = {r.part: r.source.split("\n\n") for r in sel.copy_parts(chosen).collect()}
    assert {part: len(texts) for part, texts in got.items()} == {0: 82, 1: 8}
    assert got[0][-1].startswith("81-0 ") and got[1][0].startswith("82-0 ")


@pytest.mark.parametrize("pages,want", [([2, 4, 5, 6, 7, 11], "3、5–8、12"), ([2, 3], "3、4"), ([3, 2, 3], "3、4"), ([], ""), ([0], "1")])
def test_page_ranges(spark, pages, want):
    row = spark.createDataFrame([(pages,)], "p array<bigint>").select(sel.page_ranges("p").alias("r")).first()
    assert row.r == want


def test_a_context_deals_its_copies_out_once_and_leaves_no_texts_behind(spark):
    """The copies of pages are most of the disk: one exchange holds them, packed, none holds what was put
    together, and the tables of blocks and sentences are gone by then."""
    import os
    import re

    from quire import session
    from quire.plans import queries_reading as q

    with session.recorded() as paths:
        df = q.QUERIES["bilingual_context"](spark, "/root/testdata/sf0.001")
    assert df.count() == 200
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in paths if os.path.exists(p.removeprefix("file:"))}
    assert left == {"pages", "places", "terms"}
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    dealt = [frozenset(re.findall(r"(\w+)#", c)) for c in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)]
    assert dealt and not any("_body" in columns for columns in dealt)
    assert len({columns for columns in dealt if {"lines", "request_id"} <= columns}) == 1


def test_packed_lines_come_back_whole(spark):
    texts = ["", "a", "é — 界\n    «x»", "\x01 \U0001d465", "long " * 500_000, "b"]
    pages = ctx.packed(spark.createDataFrame(list(enumerate(texts)), "p int, lines string"), "lines")
    assert pages.schema["lines"].dataType.simpleString() == "binary"
    one = F.struct(F.concat(F.lit("h"), F.col("p").cast("string")).alias("heading"), "lines")
    got = {r.p: r.body for r in ctx.joined_sections(pages.select("p", F.array(one).alias("body")), "body").collect()}
    assert got == {i: f"h{i}" + ("\n" + t if t else "") + "\n" for i, t in enumerate(texts)}
    every = pages.groupBy().agg(F.array_sort(F.collect_list(F.struct("p", one.alias("s")))).alias("all")).select(F.lit(1).alias("k"), F.col("all.s").alias("body"))
    assert ctx.joined_sections(every, "body").first().body == "\n".join(got[i] for i in range(len(texts)))


def test_chosen_sentences_are_shown_from_their_first_place(spark):
    rows = sentences(spark).withColumn("sentence_id", F.concat(F.lit("id"), F.length("text").cast("string")))
    asked = [(1, "d", 9, "id4"), (1, "d", 3, "id6"), (2, "d", 1, "nowhere"), (2, "d", 2, "id5")]
    places = ctx.selected_places(spark.createDataFrame(asked, "request_id int, deck_id string, seq bigint, sentence_id string"), rows)
    assert {(r.request_id, r.seq): (r.page_index, r.block_index, r.sent_index) for r in places.collect()} == {
        (1, 9): (0, 2, 1), (1, 3): (0, 2, 2), (2, 2): (0, 0, 0)}
    titles = spark.createDataFrame([("d", 0, "Title"), ("d", 1, ""), ("d", 2, "None")], "deck_id string, page_index bigint, title string")
    code, known = rows.where("kind = 'code'"), rows.where("translation IS NOT NULL")
    pages = ctx.context_pages(titles, code, rows.drop("translation"), known, places.select(*sel.UNIT).distinct())
    assert {r.page_index: (r.title, r.lines) for r in pages.collect()} == {
        0: ("Title", "# Title\n    标题\n- Label\n- One. \n    一。\n- Two.\n    二。\n- Three.\n- x = 1"),
        1: ("", "- Next.\n    下。"), 2: ("None", ""),
    }
    assert {r.request_id: r.selection for r in ctx.selection_text(ctx.selected_texts(places, pages)).collect()} == {
        1: "The student selected these 2 sentences:\n  1. Three.\n  2. Two.\n     (shown to them as: 二。)",
        2: "The student selected this sentence:\n  Title\n     (shown to them as: 标题)",
    }


@pytest.mark.parametrize("picked,anchor,want", [([9, 10], 5, [5, 9, 10]), ([], 5, [5]), ([5, 5, -1, 99], 5, [5]), (list(range(30)), 29, [*range(30)])])
def test_wanted_pages(spark, picked, anchor, want):
    row = spark.createDataFrame([(picked, 40, anchor)], "p array<bigint>, n bigint, a bigint").select(
        ctx.wanted_pages(F.col("p"), F.col("n"), F.col("a")).alias("w")
    ).first()
    assert row.w == want


def test_stream_fragments(spark):
    lines = [": ping", 'data: {"choices":[{"delta":{"reasoning":"hm"}}]}', 'data: {"choices":[{"delta":{"content":"Hel"}}]}', "data: {oops", 'data:{"choices":[{"delta":{"content":"lo"}}]}',
             'data: {"choices":[],"usage":{"prompt_tokens":7,"completion_tokens":2}}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"!"}}]}']
    rows = [(1, i, s) for i, s in enumerate(lines)] + [(2, 0, 'data: {"choices":[{"delta":{"content":"open"}}]}')]
    got = {r.message_id: (r.text, r.prompt_tokens) for r in ctx.assemble_fragments(spark.createDataFrame(rows, "message_id int, seq int, line string")).collect()}
    assert got == {1: ("Hello", 7), 2: ("open", None)}


def test_one_message_with_half_of_all_frames(spark):
    n = F.col("id")
    line = F.when(n == 29_000, "data: [DONE]").otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), n.cast("string"), F.lit(' "}}]}')))
    hot = spark.range(30_000).select(F.lit(1).alias("message_id"), n.cast("int").alias("seq"), line.alias("line"))
    rest = spark.range(30_000).select((n % 3000 + 2).cast("int").alias("message_id"), n.cast("int").alias("seq"), line.alias("line"))
    got = {r.message_id: r.text for r in ctx.assemble_fragments(hot.union(rest)).where("message_id < 5").collect()}
    assert got[1] == "".join(f"{i} " for i in range(29_000))
    assert got[2] == "".join(f"{i} " for i in range(0, 30_000, 3000))
    ended = spark.createDataFrame([(1, 0, "data: [DONE]"), (1, 1, "data: {}")], "message_id int, seq int, line string")
    assert [(r.text, r.prompt_tokens) for r in ctx.assemble_fragments(ended).collect()] == [("", None)]


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chat_request_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 5, "user", "q2")], TURNS)
    got = [(r.position, r.role, r.content) for r in ctx.chat_requests(turns, F.lit("sys"), F.lit("ctx")).orderBy("position").collect()]
    assert got == [(0, "system", "sys"), (1, "user", "ctx"), (2, "assistant", ctx.ACKNOWLEDGEMENT), (3, "user", "q1"), (4, "assistant", "a1"), (5, "user", "q2")]


def test_titles_append_and_edit(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "  "), (1, 2, "user", "y" * 50), (2, 0, "assistant", "a")], TURNS)
    assert {r.conv_id: r.title for r in conv.titles(turns).collect()} == {1: "y" * 50, 2: conv.DEFAULT_TITLE}
    assert {r.conv_id: r.title for r in conv.titles(turns, most=40).collect()} == {1: "y" * 40, 2: conv.DEFAULT_TITLE}
    fresh = spark.createDataFrame([(2, 0, "user", "late"), (3, 0, "user", "new")], TURNS)
    after = conv.append(turns, fresh)
    assert [(r.turn, r.text) for r in after.where("conv_id = 2").orderBy("turn").collect()] == [(0, "a"), (1, "late")]
    titles = conv.titles(after)
    assert {r.conv_id: r.title for r in titles.collect()} == {1: "y" * 50, 2: "late", 3: "new"}
    renames = spark.createDataFrame([(1, " " + "z" * 70), (2, "  ")], "conv_id bigint, new_title string")
    edited = conv.edit(titles, renames, spark.createDataFrame([(3,)], "conv_id bigint"))
    assert {r.conv_id: r.title for r in edited.collect()} == {1: "z" * 70, 2: conv.DEFAULT_TITLE}


def test_message_text(spark):
    row = spark.createDataFrame([([("text", " a"), ("image", "no"), ("text", None), ("text", "b ")],)], "c array<struct<type:string,text:string>>")
    assert row.select(conv.message_text("c").alias("t")).first().t == "a  b"
