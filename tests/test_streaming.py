from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quire import session
from quire.streaming import decks, feeds


def feed(spark, rows, ddl, name):
    """Every row in a file of its own, given one after another; the last file comes twice."""
    path = session.work_path(spark, name)
    for row in [*rows, rows[-1]]:
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(path)
    return feeds.read_feed(spark, path, spark.createDataFrame(rows, ddl).schema, files_per_batch=2)


def test_page_events_may_come_late_and_twice(spark):
    rows = [("d", 1, 5, "new"), ("d", 1, 2, "old"), ("d", 2, 1, "x"), ("d", 2, 3, "y")]
    state = feeds.page_state(feed(spark, rows, "deck string, page int, event_id int, body string", "ev"), ["deck", "page"], "event_id")
    got = {r.page: r.body for r in feeds.run_to_end(spark, state, ["deck", "page"], "ev").collect()}
    assert got == {1: "new", 2: "y"}


def test_first_rendering_is_by_event_order(spark):
    rows = [(9, "key", "late"), (1, "Key", "first"), (4, " ", "x"), (5, "row", "r")]
    state = feeds.glossary_state(feed(spark, rows, "seq int, term string, translation string", "terms"))
    got = {r.term: (r.translation, r["count"]) for r in feeds.run_to_end(spark, state, ["term"], "terms").collect()}
    assert got == {"key": ("first", 2), "row": ("r", 2)}


def at(seconds):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=seconds)


PAGES = "deck string, page string, seq bigint, at timestamp, body string"
SNAPSHOTS = "deck string, seq bigint, at timestamp, pages array<struct<page:string,body:string>>"


def deck_feed(spark, batches, slots=4):
    """One file a batch, each of page events and snapshots."""
    path = session.work_path(spark, "decks")
    for pages, snapshots in batches:
        rows = decks.events(spark.createDataFrame(pages, PAGES), spark.createDataFrame(snapshots, SNAPSHOTS), slots)
        rows.coalesce(1).write.mode("append").parquet(path)
    return feeds.read_feed(spark, path, rows.schema, files_per_batch=1)


def final(spark, feed, keep=None):
    done = feeds.run_to_end(spark, decks.deck_changes(feed, keep), ["deck", "page"], "decks").where("NOT gone")
    return {(r.deck, r.page): (r.seq, r.body) for r in done.collect()}


def test_a_late_or_repeated_snapshot_and_replayed_pages_change_nothing(spark):
    pages = [("d", f"p{i}", i, at(i), f"old {i}") for i in range(6)]
    snapshot = ("d", 10, at(10), [("p1", "snap"), ("p9", "snap")])
    later = [("d", "p1", 12, at(12), "new"), ("d", "p3", 11, at(11), None)]
    early = ("d", 3, at(3), [("p0", "early"), ("p5", "early")])
    want = {("d", "p1"): (12, "new"), ("d", "p9"): (10, "snap"), ("d", "p3"): (11, None), ("e", "x"): (1, "other")}
    other = [("e", "x", 1, at(1), "other")]
    orders = [
        [(pages, []), (other, [snapshot]), (later, [])],  # as it happened
        [(later, []), (other, [snapshot]), (pages, []), ([], [early]), (pages, [snapshot])],  # late, repeated, replayed
    ]
    for batches in orders:
        assert final(spark, deck_feed(spark, batches)) == want


def test_decks_without_events_are_dropped_by_a_timer(spark):
    batches = [([("old", "a", 1, at(0), "x"), ("new", "b", 2, at(0), "y")], [])]
    batches += [([("new", "b", 2 + i, at(100 * i), f"y{i}")], []) for i in range(1, 6)]
    assert final(spark, deck_feed(spark, batches), keep=150_000) == {("new", "b"): (7, "y5")}
    assert ("old", "a") in final(spark, deck_feed(spark, batches))


def test_a_hot_deck_is_spread_over_slots(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("deck"), F.col("id").cast("string").alias("page"), F.col("id").alias("seq"), F.lit(at(0)).alias("at"), F.lit("b").alias("body"))
    slots = decks.events(rows, spark.createDataFrame([("hot", 500, at(1), [])], SNAPSHOTS)).groupBy("slot").count().collect()
    assert len(slots) == decks.SLOTS and max(r["count"] for r in slots) < 120


def test_only_large_decks_have_more_than_one_slot(spark):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("d"), F.col("id"))).alias("deck"), F.concat(F.lit("p"), F.col("id") % 40).alias("page"),
        F.col("id").alias("seq"), F.lit(at(0)).alias("at"), F.lit("b").alias("body"),
    )
    large = decks.slots_by_size(rows, slots=4, span=100)
    assert [tuple(r) for r in large.collect()] == [("hot", 4)]
    snapshots = spark.createDataFrame([("hot", 880, at(1), [("p1", "snap")]), ("d950", 990, at(1), [("p2", "snap")])], SNAPSHOTS)
    feed = decks.events(rows, snapshots, large)
    slots = {r.deck: r.n for r in feed.groupBy("deck").agg(F.count_distinct("slot").alias("n")).collect()}
    assert slots.pop("hot") == 4 and set(slots.values()) == {1} and len(slots) == 100
    # a mark for each slot there is
    assert feed.where("page IS NULL").count() == 5
    path = session.work_path(spark, "decks")
    feed.write.parquet(path)
    got = final(spark, feeds.read_feed(spark, path, feed.schema))
    assert got[("d950", "p2")] == (990, "snap") and ("d950", "p30") not in got and got[("d951", "p31")] == (951, "b")
    assert {k[1]: v for k, v in got.items() if k[0] == "hot"} == {"p1": (880, "snap")} | {f"p{i % 40}": (i, "b") for i in range(880, 900)}
