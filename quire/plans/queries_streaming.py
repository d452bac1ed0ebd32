"""Queries on the live feeds: each runs the stream to its end and returns the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import session
from quire.operators import ledger as led
from quire.oracles import base as o
from quire.oracles import tables  # noqa: F401 - registers the views
from quire.sources import derived
from quire.sources.corpus import table
from quire.streaming import decks, feeds

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = o.with_views(sql, *needs)
        return fn

    return keep


def as_feed(spark, rows, name, batches=3):
    """Lay a table down as files, written by the tasks that make its rows, that arrive in a few batches."""
    path = session.work_path(spark, f"{name}-feed")
    rows.write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return feeds.read_feed(spark, path, rows.schema, files_per_batch=max(1, -(-files // batches)))


@query(
    "stream_page_state",
    """SELECT user_id AS deck, event_type AS page, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props
       FROM events GROUP BY 1, 2""",
)
def stream_page_state(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("deck"), F.col("event_type").alias("page"), "event_id", "value", "props"
    )
    feed = as_feed(spark, rows, "pages")
    return feeds.run_to_end(spark, feeds.page_state(feed, ["deck", "page"], "event_id"), ["deck", "page"], "pages")


@query(
    "stream_deck_sync",
    """WITH snaps AS (SELECT user_id AS deck, event_id AS seq FROM events WHERE event_id % 97 = 5),
       pages AS (
         SELECT user_id AS deck, event_type AS page, event_id AS seq, props AS body FROM events WHERE event_id % 97 <> 5
         UNION ALL SELECT deck, unnest(['click', 'extra']), seq, 'snapshot ' || seq FROM snaps)
       SELECT deck::VARCHAR AS deck, page, max(seq) AS seq, arg_max(coalesce(body, chr(0)), seq) AS body FROM pages
       WHERE seq >= coalesce((SELECT max(s.seq) FROM snaps s WHERE s.deck = pages.deck), -1) GROUP BY 1, 2""",
)
def stream_deck_sync(spark, sf):
    """Decks of users: most events carry a page, some are snapshots of two pages that replace all others."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("deck"), F.col("event_type").alias("page"), F.col("event_id").alias("seq"),
        F.timestamp_seconds(F.lit(derived.EPOCH) + F.col("event_id")).alias("at"), F.col("props").alias("body"),
    )
    whole = F.col("seq") % 97 == 5
    text = F.concat(F.lit("snapshot "), F.col("seq").cast("string"))
    held = F.array(*(F.struct(F.lit(p).alias("page"), text.alias("body")) for p in ("click", "extra")))
    snapshots = rows.where(whole).select("deck", "seq", "at", held.alias("pages"))
    feed = as_feed(spark, decks.events(rows.where(~whole), snapshots, decks.slots_by_size(rows)), "decks")
    state = feeds.run_to_end(spark, decks.deck_changes(feed), ["deck", "page"], "decks")
    return state.where("NOT gone").select("deck", "page", "seq", F.coalesce("body", F.lit("\u0000")).alias("body"))


@query(
    "stream_glossary",
    f"""SELECT {o.fold(o.strip('term'))} AS term, arg_min({o.strip('translation')}, seq) AS translation, min(seq) AS first_seq, count(*) AS count
        FROM proposals WHERE {o.strip('term')} <> '' AND {o.strip('translation')} <> '' GROUP BY 1""",
    "proposals",
)
def stream_glossary(spark, sf):
    feed = as_feed(spark, derived.proposals(spark, sf), "terms")
    return feeds.run_to_end(spark, feeds.glossary_state(feed), ["term"], "terms")


@query(
    "stream_spend",
    """SELECT model, kind, count(*) AS calls, round(sum(cny), 6) AS cny, sum(prompt)::BIGINT AS prompt_tokens,
         sum(completion)::BIGINT AS completion_tokens FROM priced_calls GROUP BY 1, 2""",
    "priced_calls",
)
def stream_spend(spark, sf):
    feed = as_feed(spark, derived.calls(spark, sf), "calls")
    ledger = led.price_calls(feed, derived.prices(spark), derived.fx(spark))
    state = feeds.run_to_end(spark, feeds.spend_state(ledger), ["model", "kind"], "spend")
    return state.withColumn("cny", F.round("cny", 6))
