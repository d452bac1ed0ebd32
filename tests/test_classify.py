from __future__ import annotations

from builders import block, deck, kinds
from pyspark.sql import functions as F

from quire.operators import classify as cl
from quire.operators import model


def run(df):
    return cl.classified_blocks(df)


def test_repeated_text_at_one_place_is_furniture_and_body_stays(spark):
    pages = [[block("Course Nav", y=0.0), block(f"Body number {i} says something.", y=0.4)] for i in range(8)]
    got = kinds(run(deck(spark, pages)))
    assert all(got[p, 0] == "chrome" and got[p, 1] == "body" for p in range(8))


def test_a_title_with_the_words_of_the_navigation_stays_a_title(spark):
    pages = [[block("Design Process", y=0.0), block(f"Text {i} of the lecture.", y=0.5)] for i in range(8)]
    pages[4].insert(1, block("Design Process", y=0.15, title=True, placeholder="TITLE"))
    got = kinds(run(deck(spark, pages)))
    assert got[4, 0] == "chrome" and got[4, 1] == "title"


def test_two_pages_are_too_few_and_long_text_is_kept(spark):
    few = kinds(run(deck(spark, [[block("Nav", y=0.0), block("One thing here.")], [block("Nav", y=0.0), block("Other thing here.")]])))
    assert few[0, 0] == "body"
    long = "A definition that is restated on every page on purpose because it is important to know by heart."
    got = kinds(run(deck(spark, [[block(long, y=0.5), block(f"Text {i}.")] for i in range(6)])))
    assert all(got[p, 0] == "body" for p in range(6))


def test_position_tells_repeats_apart(spark):
    pages = [[block("Moving", y=0.1 * i), block(f"Line {i} here.", y=0.95)] for i in range(8)]
    got = kinds(run(deck(spark, pages)))
    assert all(got[p, 0] == "body" for p in range(8))


def test_page_numbers(spark):
    got = kinds(cl.classify(deck(spark, [[block("12 / 40", y=0.95), block("12", y=0.5), block("12a", y=0.95)]])))
    assert got == {(0, 0): "chrome", (0, 1): "body", (0, 2): "body"}


def test_verbatim_text_comes_before_prose_rules(spark):
    page = [
        block("SELECT 1", y=0.05, font=40.0, mono=True), block("x ∈ S", math_only=True), block("cell", table_r=0),
        block("Student", depth=1), block("The student attends a class here", depth=1), block("Ends.", depth=2),
    ]
    got = kinds(run(deck(spark, [page])))
    assert [got[0, i] for i in range(6)] == ["code", "code", "fragment", "fragment", "caption", "caption"]


def test_title_fallback_needs_the_largest_text_and_no_title_before(spark):
    top = [block("A Short Heading", y=0.05, font=30.0), block("Second Heading", y=0.1, font=30.0), block("Body text goes on.", font=14.0)]
    got = kinds(run(deck(spark, [top])))
    assert [got[0, i] for i in range(3)] == ["title", "body", "body"]
    unknown = kinds(run(deck(spark, [[block("A Short Heading", y=0.05), block("Body text goes on.")]])))
    assert unknown[0, 0] == "body"
    later = [block("Heading", y=0.1, font=30.0), block("Real", y=0.2, title=True, font=30.0)]
    assert kinds(run(deck(spark, [later])))[0, 0] == "title"


def test_captions_lie_on_a_figure(spark):
    page = [block("Fig label", y=0.5, h=0.05), block("It ends a sentence.", y=0.5), block("Above", y=0.0, h=0.25)]
    images = {0: [dict(x=0.0, y=0.25, w=1.0, h=0.6)]}
    got = kinds(run(deck(spark, [page], images=images)))
    # touching edges do not overlap
    assert [got[0, i] for i in range(3)] == ["caption", "body", "body"]


def test_rescue_restores_inferred_furniture_only(spark):
    got = cl.classified_blocks(deck(spark, [[block("Same", y=0.0)] for _ in range(8)]))
    assert set(kinds(got).values()) == {"body"}
    assert cl.rescue_warnings(got).count() == 8
    footer = cl.classified_blocks(deck(spark, [[block("Footer", chrome=True, placeholder="FOOTER")], [block("Some text here.")]]))
    assert kinds(footer) == {(0, 0): "chrome", (1, 0): "body"}


def test_no_page_is_left_unreadable_unless_the_file_says_so(spark):
    from quire.plans import stages

    c = stages.classified(spark, "/root/testdata/sf0.001")
    pages = c.withColumn("r", model.in_reading_flow()).groupBy("deck_id", "page_index").agg(
        {"r": "max", "reason": "max"}
    )
    bad = c.where("kind = 'chrome' AND NOT startswith(reason, 'placeholder:')").select("deck_id", "page_index").distinct()
    empty = pages.where("NOT `max(r)`")
    assert empty.join(bad, ["deck_id", "page_index"], "left_semi").where("`max(reason)` IS NULL").count() == 0


def test_furniture_without_broadcast_gives_the_same(spark):
    df = deck(spark, [[block("Nav", y=0.0), block(f"Body {i}.", y=0.4)] for i in range(20)])
    featured = df.withColumn("_bare", F.trim("text"))
    rows = lambda: sorted(map(str, cl.with_furniture(featured).select("page_index", "block_index", "pages_seen").collect()))
    usual = rows()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == usual
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_fingerprint_follows_one_rule_at_every_size(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for size in (1, 2_000_000):  # the larger deck has ten million characters
        pages = [[block(f"t{p}-{i} " + "x" * size) for i in range(1)] for p in range(5)]
        df = deck(spark, pages)
        want = "".join(sha("".join(b["text"] for b in p)) for p in pages)
        for _ in range(4):
            want = sha(want)
        assert model.deck_fingerprint(df).first().fingerprint == want[:16]
        swapped = deck(spark, [pages[1], pages[0], *pages[2:]])
        assert model.deck_fingerprint(swapped).first().fingerprint != want[:16]


def test_line_blocks_hold_every_line_unchanged(spark):
    from quire.sources import views
    from quire.sources.corpus import table

    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: [s for s in r.text.split("\n") if s.strip()] for r in table(spark, sf, "documents").collect()}
    got = {}
    for r in views.blocks(spark, sf).orderBy("doc_id", "block_index").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for doc, lines in want.items():
        rest = iter(got[doc])
        assert all(line in rest for line in lines), doc
