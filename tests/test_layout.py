from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import layout as lay
from quire.operators import markdown as md

LINE = "page int, k int, text string, x double, y double, w double, h double, font_pt double, mono boolean, bullet boolean"


def paragraphs(spark, lines):
    """Merged paragraphs of one page of (text, x, y, font, mono, bullet); every line is 0.5 wide and 0.02 high."""
    rows = [(0, i, t, x, y, 0.5, 0.02, font, mono, bullet) for i, (t, x, y, font, mono, bullet) in enumerate(lines)]
    return [(r.text, r.lines) for r in lay.merge_paragraphs(spark.createDataFrame(rows, LINE), ["page"], "k").orderBy("first").collect()]


def test_what_parts_paragraphs(spark):
    plain = lambda t, x, y, font=12.0, mono=False, bullet=False: (t, x, y, font, mono, bullet)
    cases = {
        "close lines join": ([plain("rain fell", 0.1, 0.1), plain("all day", 0.1, 0.12)], [("rain fell all day", 2)]),
        "a wide gap": ([plain("rain fell", 0.1, 0.1), plain("all day", 0.1, 0.2)], [("rain fell", 1), ("all day", 1)]),
        "another size": ([plain("Weather", 0.1, 0.1, 18.0), plain("all day", 0.1, 0.12)], [("Weather", 1), ("all day", 1)]),
        "another face": ([plain("rain fell", 0.1, 0.1), plain("x = 1", 0.1, 0.12, mono=True)], [("rain fell", 1), ("x = 1", 1)]),
        "out to the left": ([plain("rain fell", 0.3, 0.1), plain("all day", 0.1, 0.12)], [("rain fell", 1), ("all day", 1)]),
        "a list mark": ([plain("to bring:", 0.1, 0.1), plain("(c) boots", 0.1, 0.12)], [("to bring:", 1), ("(c) boots", 1)]),
        "a list item": ([plain("boots", 0.1, 0.1, bullet=True), plain("coat", 0.1, 0.12)], [("boots", 1), ("coat", 1)]),
        "three in a row": ([plain("a-", 0.1, 0.1), plain("b c", 0.1, 0.12), plain("d", 0.1, 0.14)], [("ab c d", 3)]),
    }
    for name, (lines, want) in cases.items():
        assert paragraphs(spark, lines) == want, name


def test_wrapped_words_and_listings(spark):
    rows = [(0, 0, "an infor-", 0.1, 0.10, 0.5, 0.02, 12.0, False, False), (0, 1, "mation here", 0.1, 0.12, 0.5, 0.02, 12.0, False, False),
            (0, 2, "• item", 0.1, 0.14, 0.5, 0.02, 12.0, False, False), (0, 3, "int x;", 0.1, 0.2, 0.5, 0.02, 12.0, True, False), (0, 4, "  y();", 0.1, 0.22, 0.5, 0.02, 12.0, True, False)]
    got = lay.merge_paragraphs(spark.createDataFrame(rows, LINE), ["page"], "k").orderBy("first")
    assert [(r.text, r.lines) for r in got.collect()] == [("an information here", 2), ("• item", 1), ("int x;\n  y();", 2)]


def segments(spark, lines, mono=False):
    df = spark.createDataFrame([(0, i, s, mono) for i, s in enumerate(lines)], "block int, line_no int, line string, mono boolean")
    return [(r.text, r.bullet, r.depth) for r in lay.bullet_segments(df, ["block"]).orderBy("segment").collect()]


def test_lists_are_taken_apart_and_paragraphs_are_not(spark):
    assert segments(spark, ["Goal", "• solve it", "well", "- use data", "(b) third"]) == [
        ("Goal", False, 1), ("solve it well", True, 0), ("use data", True, 1), ("third", True, 1)]
    assert segments(spark, ["a wrapped infor-", "mation line"]) == [("a wrapped information line", False, 0)]
    assert segments(spark, ["- x = 1", "  - y"], mono=True) == [("- x = 1\n  - y", False, 0)]


def test_reading_order_rounds_half_to_even(spark):
    rows = [(0, 0, 0.0125, 0.9), (0, 1, 0.0, 0.95), (0, 2, 0.0375, 0.1)]  # bands 0, 0 and 2
    df = spark.createDataFrame(rows, "page int, i int, y double, x double")
    assert [r.i for r in lay.reading_order(df, ["page"], ["i"]).orderBy("reading_rank").collect()] == [0, 1, 2]


def test_coverage(spark):
    df = spark.createDataFrame([("a", False), ("a", False), ("b", True), ("b", False), ("c", True), ("c", False), ("c", False)], "deck_id string, has_text boolean")
    assert {r.deck_id: r.coverage for r in lay.text_coverage(df).collect()} == {"a": "scan", "b": "ok", "c": "partial"}


def test_page_breaks_never_make_an_empty_page(spark):
    df = spark.createDataFrame([(0, 0, True), (0, 1, False), (0, 2, True), (0, 3, True)], "doc int, k int, starts_page boolean")
    assert [r.page for r in lay.paginate_breaks(df, ["doc"], "k").orderBy("k").collect()] == [0, 0, 1, 2]


def test_math(spark):
    runs = [(0, 0, False, "Let "), (0, 1, True, "𝑥²"), (1, 0, True, "𝐶𝑂𝑀𝑃"), (1, 1, False, " → "), (2, 0, False, "just １ text")]
    got = {r.b: (r.text, r.has_math, r.math_only, r.math_only_doc) for r in lay.math_flags(spark.createDataFrame(runs, "b int, run int, is_math boolean, text string"), ["b"]).collect()}
    assert got == {0: ("Let x2", True, False, False), 1: ("COMP →", True, True, True), 2: ("just １ text", False, False, False)}


def pages_of(spark, text):
    df = spark.createDataFrame([(0, text)], "doc int, text string")
    return md.md_pages(df)


def blocks_of(spark, text):
    rows = md.md_blocks(spark.createDataFrame([(0, text)], "doc int, text string")).orderBy("page", "block_index").collect()
    return [(r.page, r.text) for r in rows]


def test_fences_close_only_on_their_own_mark(spark):
    text = "a\n```py\nx\n~~~\n```\nb\n~~~~\n```\n~~~\nc\n```\nopen"
    rows = md.md_fences(spark.createDataFrame([(0, text)], "doc int, text string")).orderBy("line_no").collect()
    assert [r.line_no for r in rows if r.in_fence] == [1, 2, 3, 4, 6, 7, 8, 10, 11]


@pytest.mark.parametrize("text,n", [
    ("one\n\n---\n\ntwo\n\n***\n\nthree", 3), ("Title\n---\nbody", 1), ("# A\nx\n# B\ny", 2), ("pre\n# A\n# B", 3), ("## A\n## B\n### C", 2),
    ("# only\n## A\n## B", 3), ("plain\ntext", 1), ("# One\n\n```\n---\n```\n\nStill one", 1), ("---\n\na\n\n---\n\n---\n", 1), ("a\r\n\r\n---\r\n\r\nb", 2),
])
def test_page_splits(spark, text, n):
    assert pages_of(spark, text).select("page").distinct().count() == n


def test_blocks_of_a_note(spark):
    text = "# Head **bold** #\npara one\nline two\n\n- item\n  - sub [x](u)\n> quoted\n>\n```\ncode\n  deep\n```\n| a | |\n|---|---|\n| `b` | c |\nlast"
    assert blocks_of(spark, text) == [(0, t) for t in [
        "Head bold", "para one line two", "item", "sub x", "quoted", "code\n  deep", "a", "b", "c", "last"]]
    rows = md.md_blocks(spark.createDataFrame([(0, text)], "doc int, text string")).orderBy("block_index").collect()
    assert [(r.table_r, r.table_c) for r in rows if r.table_r is not None] == [(0, 0), (1, 0), (1, 1)]
    assert [(r.heading, r.font_pt) for r in rows][0] == (1, 30.0) and rows[3].depth == 1 and rows[5].mono


def test_an_empty_fence_is_no_block(spark):
    assert blocks_of(spark, "a\n```\n\n```\nb") == [(0, "a"), (0, "b")]
    assert blocks_of(spark, "\n \n") == []


def test_notes_need_no_exchange(spark):
    df = spark.createDataFrame([(0, "# a\n- b", "x")], "doc int, text string, page string").drop("page")
    for rows in (md.md_fences(df), md.md_pages(df), md.md_blocks(df), md.md_table_cells(df)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_a_document_of_a_million_lines_takes_steps_in_proportion():
    import time

    def seconds(n):
        lines = ["```", "~~~", "```", "text", "| a | b |", "- item", "", "# head", "---"] * (n // 9)
        began = time.perf_counter()
        fenced = md.fences(lines)
        md.blocks_of(lines, fenced, md.pages_of(lines, fenced))
        return time.perf_counter() - began

    small, large = seconds(90_000), seconds(990_000)
    assert large < 25 * small


def test_no_text_and_repeated_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc int, text string")
    assert sorted((r.doc, r.text) for r in md.md_blocks(df).collect()) == [(3, "a"), (3, "a")]
    assert md.md_fences(df).count() == 5 and md.md_pages(df).count() == 2 and md.md_table_cells(df).count() == 0


ODD_TEXTS = [
    None, "", " ", "\n \n", "\r", "\u3000\n\u2028", "a", "a\rb", "a\r\nb\r\n\r\nc", "```\r\nx\r\n~~~\r\ny\r\n---\r\nz", "x\r```\ry", "a\n```\nb\n\n~~~\nc\n   ```\nd",
    "h\n*a\u2028b* and **c\x85d**\n*e\rf* _g\u2029h_", "| a |\r\n|---|\r\n| *b\rc* |",
]


def rows_and_sql(spark, tmp_path, name):
    """What a query and its SQL give over a table of odd documents."""
    import duckdb

    from quire.plans import queries_layout as q

    docs = [(i, text, "en", "s") for i, text in enumerate(ODD_TEXTS)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = q.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(q.ORACLES[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    return sorted(tuple(r) for r in df.collect()), sorted(tuple(r[i] for i in order) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["md_fences", "md_pages"])
def test_lines_of_odd_documents_are_those_of_the_sql(spark, tmp_path, name):
    """A document without a line has none, and a return ends no line."""
    got, want = rows_and_sql(spark, tmp_path, name)
    assert got == want and len(want) > 20


def test_inline_text_of_odd_documents_is_that_of_the_sql(spark, tmp_path):
    """The same lines, and emphasis may hold any separator but a line feed."""
    got, want = rows_and_sql(spark, tmp_path, "md_inline_strip")
    assert got == want and len(want) > 20


def test_notes_are_taken_apart_in_portions():
    """A batch of ten thousand notes is not held as lines all at once; rows, nulls and order stay."""
    import pyarrow as pa

    from quire.operators import markdown as md

    texts = ["a" * 300_000, None, "", "b" * (3 * md.PORTION), "c" * 900_000, "d", "é" * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(md.portions(batch, 1))
    assert [r["text"] for part in parts for r in part.to_pylist()] == texts
    sizes = [[len((r["text"] or "").encode()) for r in part.to_pylist()] for part in parts]
    assert len(parts) > 3 and all(sum(s) <= md.PORTION or sum(1 for x in s if x) == 1 for s in sizes)
    assert list(md.portions(batch.slice(0, 0), 1)) == []
