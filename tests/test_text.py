from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as tx

VECTORS = [
    ("I.e. the river froze over.", ["I.e. the river froze over."]),
    ("Ice forms at night. By noon it is gone.", ["Ice forms at night.", "By noon it is gone."]),
    ("Pi is near 3.1416 always. Check it.", ["Pi is near 3.1416 always.", "Check it."]),
    ("The count fell to 7. Nobody noticed.", ["The count fell to 7.", "Nobody noticed."]),
    ("12. Boil the water.", ["12. Boil the water."]),
    ("A letter from K. Brandt arrived. It was wet.", ["A letter from K. Brandt arrived.", "It was wet."]),
    ("Look at Fig. 9 first. Then read on.", ["Look at Fig. 9 first.", "Then read on."]),
    ("Is it cold? Yes, very!", ["Is it cold?", "Yes, very!"]),
    ("No stop at the end", ["No stop at the end"]),
    ("\t \n", []),
    ("one   two\nthree", ["one two three"]),
    ('She cried "Go." Everyone ran.', ['She cried "Go."', "Everyone ran."]),
    ("Try v2.5. Then rest.", ["Try v2.5. Then rest."]),
    ("Slowly... Then all at once.", ["Slowly... Then all at once."]),
    ("Pears, etc. Plums. Figs.", ["Pears, etc. Plums.", "Figs."]),
    ("3. 4. Move on.", ["3. 4.", "Move on."]),
    ("Über Nacht. ähnlich war es. Öfter noch.", ["Über Nacht. ähnlich war es.", "Öfter noch."]),
]


def test_segment_vectors(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VECTORS)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", tx.segment("t").alias("s")).collect()}
    assert [got[i] for i in range(len(VECTORS))] == [w for _, w in VECTORS]


WORDS = st.sampled_from(
    ["The", "key", "a", "J", "etc", "e.g", "Fig", "3", "14", "v1", "U.S", "end", "É", "no", "Next", ".", "x.y", "?", "!", '"', ")", "wait.."]
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(WORDS, st.sampled_from(["", ".", "!", "?", '."', ".)", ". ", ","])), max_size=14), min_size=40, max_size=60))
def test_segment_loses_nothing_and_keeps_to_its_places(spark, texts):
    flat = [" ".join(w + p for w, p in t) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(flat)], "i int, t string")
    for r in rows.select("i", "t", tx.segment("t").alias("s")).collect():
        assert "".join("".join(r.s).split()) == "".join(r.t.split())
        # a cut comes only after an end mark, and never before a small letter where the mark is a full stop
        for left, right in zip(r.s, r.s[1:]):
            end = left.rstrip("\"'’”)]")
            assert end[-1] in ".!?", (left, right)
            assert end[-1] != "." or not right[0].islower(), (left, right)
        # a question or exclamation mark before a space always ends a sentence
        assert not any(mark in s for s in r.s for mark in ("? ", "! ")), r.s


def test_control_characters_of_a_text_are_kept(spark):
    text = "a\u0001b \u0002\u0003 ends. Then \u0001\u0002\u0004 more. Last"
    got = spark.createDataFrame([(text,)], "t string").select(tx.segment("t").alias("s")).first().s
    assert got == ["a\u0001b \u0002\u0003 ends.", "Then \u0001\u0002\u0004 more.", "Last"]


def test_folding_is_that_of_the_standard_library(spark):
    words = ["STRASSE", "straße", "ΟΔΟΣ", "οδος", "ﬁx", "ſo", "ŉ", "İI", "ᾳ", "ΐ", "µ", "ẞ", "ﬃ", "Ǆ", "plain", ""]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", tx.fold_case("t").alias("f")).collect()
    assert [(r.t, r.f) for r in rows] == [(w, w.casefold()) for w in words]


def test_strip_and_ids(spark):
    samples = ["  key  ", "plain", "", " \t\x1cß　"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", tx.strip("t").alias("s"), tx.content_id("t").alias("id")).collect()
    for r in rows:
        assert r.s == r.t.strip()
        assert r.id == hashlib.sha256(r.t.strip().encode()).hexdigest()[:16]


def test_cache_key(spark):
    got = spark.range(1).select(tx.cache_key(F.lit("A key. "), "zh-CN", "m0").alias("k")).first().k
    assert got == hashlib.sha256("m0\x00zh-CN\x00A key.".encode()).hexdigest()[:16]


@pytest.mark.parametrize("text,count", [("", 0), ("  a  b ", 2), ("one two\nthree", 3)])
def test_word_count(spark, text, count):
    assert spark.range(1).select(tx.word_count(F.lit(text)).alias("n")).first().n == count


def test_fonts_languages_and_case(spark):
    row = spark.range(1).select(
        tx.is_monospace(F.lit("CMTT10")).alias("a"), tx.is_monospace(F.lit("Times")).alias("b"),
        tx.is_monospace(F.lit(None).cast("string")).alias("c"), tx.language_name(F.lit("zh-Hant"), "x").alias("d"),
        tx.language_name(F.lit("auto"), "x").alias("e"), tx.language_name(F.lit("tlh"), "x").alias("f"),
        tx.fold_case(F.lit("STRAßE")).alias("g"), tx.fold_case_exact(F.lit("STRAßE")).alias("h"), tx.fold_math(F.lit("𝑥²")).alias("i"),
    ).first()
    assert tuple(row) == (True, False, False, "Traditional Chinese", "x", "tlh", "strasse", "strasse", "x2")


def test_markdown_and_html(spark):
    row = spark.range(1).select(
        tx.strip_markdown(F.lit("![alt *x*](a.png) [label](u) `code` **bold *in* it** __u__")).alias("m"),
        tx.html_to_text(F.lit("<p>a&nbsp;b</p><SCRIPT>x</SCRIPT><nav\n>y</nav>c &amp; d")).alias("h"),
        tx.join_soft_hyphens(F.lit("informa-\ntion well-\nKnown 3-\n4")).alias("s"),
    ).first()
    assert row.m == "alt x label code bold in it u"
    assert row.h == "a b c & d"
    assert row.s == "information well-\nKnown 3-\n4"


def test_exploded_arrays_are_worked_out_once(spark):
    """No filter works out blocks, sentences or keys a first time, only to see whether there are any."""
    from quire.plans import stages
    from quire.sources import views

    for df in (views.blocks(spark, "/root/testdata/sf0.001"), stages.sentences(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        worked = [line for line in plan.splitlines() if "Filter " in line and ("split(" in line or "transform(" in line)]
        assert not worked, worked


def test_short_ways_give_what_the_long_ones_do(spark):
    """Ends of a text, gaps and counts of words are seen by quicker means; odd spaces and letters take the long way."""
    texts = ["plain", " lead", "tail　", " ", "", "a b  c", "x\x85y", "é", " é.", "“q”", "K !", " ".join("w" * 12), " ".join("w" * 13), None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", tx.strip("t").alias("s"), tx.collapse_ws("t").alias("c"), tx.words_up_to("t", 12).alias("n")
    ).collect()
    for r in rows:
        t = texts[r.i]
        want = (None, None, None) if t is None else (t.strip(), " ".join(t.split()), min(len(t.split()), 13))
        assert (r.s, r.c, r.n) == want, t


def test_long_texts_are_not_counted_to_their_end(spark):
    """No rule asks for more words than its limit, so no plan of the rules counts all words of every block."""
    from quire.operators import classify as cl

    blocks = spark.createDataFrame([("one two " * 50,)], "text string")
    assert cl.with_features(blocks).first()["_words"] == cl.TITLE_MAX_WORDS + 1


def test_a_cache_key_is_that_of_the_stripped_text_however_it_ends(spark):
    texts = ["a", "a ", " a", "a\u3000", "界", "é", "", " ", "a\n", "a.", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for model in ("m0", " m"):
        lead = F.lit(f"{model}\x00de\x00")
        rows = df.select(tx.cache_key("t", "de", model).alias("a"), tx.content_id(F.concat(lead, F.col("t"))).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a == rows[1].a != rows[2].a
