from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import memory as mem

UNITS = "deck_id string, shard bigint, page_index bigint, block_index bigint, sent_index bigint, unit_id bigint, text string, kind string"
REPLIES = "deck_id string, shard bigint, page_index bigint, attempt bigint, reply string"


def units(spark, texts, page=0, kind="body"):
    return spark.createDataFrame([("d", 0, page, 0, i, i + 1, t, kind) for i, t in enumerate(texts)], UNITS)


def replies(spark, raw, page=0):
    return spark.createDataFrame([("d", 0, page, a, r) for a, r in enumerate(raw)], REPLIES)


def answer(units, glossary=None):
    return json.dumps({"units": units, "glossary": glossary or {}}, ensure_ascii=False)


def outcome(spark, texts, raw):
    done = mem.accept_checks(mem.retry_rounds(units(spark, texts), replies(spark, raw)))
    return {r.unit_id: (r.translation, r.flagged, r.failed) for r in done.collect()}


def test_reply_deviations_are_read(spark):
    raw = ["```json\n" + answer({"[1]": "a", "2": "b", "x": "c"}) + "\n```", '{"glossary": {}}', "no json", "", "[1]", answer({"1": "old", "[1]": "new"})]
    rows = mem.parse_reply(replies(spark, raw)).collect()
    assert sorted((r.attempt, r.unit_id, r.answer) for r in rows) == [(0, 1, "a"), (0, 2, "b"), (5, 1, "new")]
    errors = {r.attempt for r in mem.reply_errors(replies(spark, raw)).collect()}
    assert {2, 3} <= errors and not {0, 1, 5} & errors


def test_a_missing_unit_is_asked_again(spark):
    got = outcome(spark, ["one thing", "two things"], [answer({"1": "eins"}), answer({"2": "zwei", "1": "later"})])
    assert got == {1: ("eins", False, False), 2: ("zwei", False, False)}


def test_what_never_comes_back_has_failed(spark):
    got = outcome(spark, ["one thing", "two things"], [answer({"1": "eins"})] * 4)
    assert got[2] == (None, True, True)


def test_a_fourth_round_does_not_happen(spark):
    got = outcome(spark, ["one thing"], [answer({}), answer({}), answer({}), answer({"1": "late"})])
    assert got[1] == (None, True, True)


def test_an_error_ends_the_page(spark):
    got = outcome(spark, ["one thing", "two things"], [answer({"1": "eins"}), "broken", answer({"2": "zwei"})])
    assert got == {1: ("eins", False, False), 2: (None, True, True)}


def test_answers_are_judged(spark):
    long = "x" * (4 * len("a b c d e") + 61)
    got = outcome(spark, ["a b c d e", "a b c d e", "a b c", "key"], [answer({"1": long, "2": "a b c d e", "3": "a b c", "4": " "}), answer({"4": "never looked at"})])
    assert got[1] == (long, True, False)
    assert got[2] == ("a b c d e", True, False)
    assert got[3] == ("a b c", False, False)
    assert got[4] == (None, True, True)


def test_page_results_count_rounds(spark):
    u = units(spark, ["one thing", "two things"])
    looked = u.withColumn("translation", F.lit(None).cast("string"))

    def errors(raw):
        r = replies(spark, raw)
        done = mem.accept_checks(mem.retry_rounds(u, r))
        row = mem.page_results(looked, done, r).first()
        return row.translated, row.failed, row.errors, row.ok

    assert errors([answer({"1": "a", "2": "b"})]) == (2, 0, 0, True)
    assert errors([answer({"1": "a"}), answer({"2": "b"})]) == (2, 0, 1, False)
    assert errors([answer({"1": "a"})] * 3) == (1, 1, 2, False)
    assert errors(["bad"]) == (0, 2, 1, False)
    assert errors([answer({"1": "a"}), "bad"]) == (1, 1, 2, False)


def test_lookup_and_pending(spark):
    s = units(spark, ["known", "blank", "new"]).drop("unit_id").unionByName(units(spark, ["code"], page=1, kind="code").drop("unit_id"))
    s = mem.with_cache_key(s, "zh-CN", "m0")
    cache = spark.createDataFrame([("known", "bekannt"), ("blank", "")], "source string, translation string").select(
        tx.cache_key("source", "zh-CN", "m0").alias("cache_key"), "source", "translation", F.lit(1).cast("bigint").alias("updated_at")
    )
    got = {r.text: r.translation for r in mem.cache_lookup(s, cache).collect()}
    assert got == {"known": "bekannt", "blank": None, "new": None, "code": None}
    assert [(r.text, r.unit_id) for r in mem.pending_units(s, cache).orderBy("unit_id").collect()] == [("blank", 1), ("new", 2)]


def test_upsert_last_write_wins(spark):
    ddl = "cache_key string, source string, translation string, updated_at bigint"
    old = spark.createDataFrame([("a", "A", "old", 1), ("b", "B", "keep", 9)], ddl)
    new = spark.createDataFrame([("a", "A", "mid", 2), ("a", "A", "new", 3), ("c", "C", "add", 1)], ddl)
    got = {r.cache_key: r.translation for r in mem.cache_upsert(old, new).collect()}
    assert got == {"a": "new", "b": "keep", "c": "add"}


def test_terms_match_whole_words_only(spark):
    texts = ["The monkey sat.", "A Key is unique.", "Keys differ.", "the primary  key", "primary key here", "c++ now", "Use ASP.NET now", "Schlüssel-Key", "keyß"]
    terms = spark.createDataFrame([("key",), ("primary key",), (".NET",), ("a.c",), (r"x\E",)], "term string")
    hits = mem.term_hits(units(spark, texts), terms)
    assert sorted((r.text, r.term) for r in hits.select("text", "term").collect()) == sorted([
        ("A Key is unique.", "key"), ("the primary  key", "key"), ("primary key here", "key"), ("primary key here", "primary key"),
        ("Use ASP.NET now", ".NET"), ("Schlüssel-Key", "key"),
    ])


def test_terms_are_found_where_the_sentences_are(spark):
    """Neither words nor texts are dealt out, and more terms than a task holds give the same."""
    rows = units(spark, ["The primary key.", "a primary sort", "no key here", "primary", "sort key; primary key"])
    terms = spark.createDataFrame([("key", 1), ("primary key", 2), ("primary sort", 3), ("primary key here", 4), ("--", 5)], "term string, n int")
    hits = mem.term_hits(rows, terms)
    assert "hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    want = [("The primary key.", "key", 1), ("The primary key.", "primary key", 2), ("a primary sort", "primary sort", 3), ("no key here", "key", 1),
            ("sort key; primary key", "key", 1), ("sort key; primary key", "primary key", 2)]
    for found in (hits, mem.term_hits(rows, terms, held=2)):
        assert found.columns == [*rows.columns, "term", "n"]
        assert sorted((r.text, r.term, r.n) for r in found.collect()) == sorted(want)


def test_terms_of_untranslatable_blocks_are_left(spark):
    assert mem.term_hits(units(spark, ["a key"], kind="code"), spark.createDataFrame([("key",)], "term string")).count() == 0


def test_a_failing_call_does_not_stop_the_rest(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "id int, prompt string")

    def model(prompt):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return prompt.upper()

    got = {r.id: (r.reply, r.call_error) for r in mem.batch_infer(prompts, model).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "no answer"), 3: ("GOOD", None)}


def test_one_call_per_text(spark):
    u = mem.with_cache_key(units(spark, ["same", "same", "other"]), "zh-CN", "m0")
    once = mem.infer_once_per_text(u)
    assert sorted(r.text for r in once.collect()) == ["other", "same"]


def test_a_reply_is_read_once(spark):
    """Parsing is most of the work on replies: one pass gives the answers and the errors, and replies that
    were read and written are not parsed again."""
    rows, asked = replies(spark, [answer({"1": "a"}), "not json", answer({"2": "b"})]), units(spark, ["x", "y"])
    rounds = mem.retry_rounds(asked, rows)
    assert rounds._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    read = mem.read_replies(rows).drop("reply")
    assert mem.read_replies(read) is read
    for plain, again in (
        (rounds, mem.retry_rounds(asked, read)), (mem.parse_reply(rows), mem.parse_reply(read)),
        (mem.reply_errors(rows), mem.reply_errors(read)), (mem.parse_terms(rows), mem.parse_terms(read)),
    ):
        assert plain.columns == again.columns and sorted(plain.collect()) == sorted(again.collect())
    assert {r.unit_id: r.answer for r in rounds.collect()} == {1: "a", 2: None}


def test_unit_numbers_with_signs_and_spaces(spark):
    raw = answer({" 1 ": "a", "[2]": "b", "[\u00a03]": "c", "+4": "d", "5.0": "e", "x": "f", "\u20036": "g"})
    assert {r.unit_id: r.answer for r in mem.parse_reply(replies(spark, [raw])).collect()} == {1: "a", 2: "b", 3: "c", 4: "d", 6: "g"}


def test_the_loop_classifies_its_pages_once(spark, monkeypatch):
    from quire.plans import queries_memory, stages

    calls, classified = [], stages.classified
    monkeypatch.setattr(stages, "classified", lambda *a: calls.append(a) or classified(*a))
    _, judged = queries_memory.translated_pages(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and judged.where("failed").isEmpty()


def test_asking_again_reads_sentences_that_were_written(spark):
    """Places are chosen from the sentences and joined to them: both read one table, neither splits texts."""
    from quire.plans import queries_memory

    plan = queries_memory.retranslate_one(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
