from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quire.operators import ledger as led
from quire.sources.derived import PRICES_DDL

CALLS = "call_id int, ts timestamp, provider string, model string, kind string, prompt bigint, cached bigint, completion bigint"
MONDAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=8)))


def at(hour, day=0):
    return MONDAY + dt.timedelta(days=day, hours=hour, minutes=30)


def calls(spark, *rows):
    full = [(i, r.get("ts", at(3)), r.get("provider", "deepseek"), r.get("model", "m"), r.get("kind", "ask"), r.get("prompt", 0), r.get("cached", 0), r.get("completion", 0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CALLS)


def price(spark, provider="deepseek", currency="CNY", model="m"):
    return spark.createDataFrame([(provider, model, 1.5, 0.05, 4.5, currency, 2.0)], PRICES_DDL)


def rates(spark, *rows):
    return spark.createDataFrame(list(rows), "currency string, rate double")


def cost(df):
    return [r.cny for r in df.orderBy("call_id").collect()]


def test_cached_tokens_are_not_billed_twice(spark):
    got = led.price_calls(calls(spark, dict(prompt=1000, cached=800)), price(spark), rates(spark, ("USD", 7.0)))
    assert cost(got) == [pytest.approx((200 * 1.5 + 800 * 0.05) / 1e6)]


def test_peak_hours_double_on_weekdays(spark):
    hours = [(3, 0), (10, 0), (9, 0), (8, 0), (12, 0), (14, 0), (17, 0), (18, 0), (10, 5), (10, 6)]
    got = led.price_calls(calls(spark, *[dict(ts=at(h, d), completion=1_000_000) for h, d in hours]), price(spark), rates(spark, ("USD", 7.0)))
    assert cost(got) == [4.5, 9.0, 9.0, 4.5, 4.5, 9.0, 9.0, 4.5, 4.5, 4.5]


def test_what_cannot_be_priced_is_counted_apart(spark):
    rows = calls(spark, dict(model="other", completion=10), dict(provider="ollama", model="any", completion=10), dict(completion=1_000_000))
    ledger = led.price_calls(rows, price(spark), rates(spark, ("USD", 7.0)))
    t = led.spend_totals(ledger, F.lit(at(3)).cast("timestamp")).first()
    assert (t.total, t.calls, t.unpriced_calls) == (4.5, 3, 1)
    assert [r.model for r in led.unpriced_models(ledger).collect()] == ["other"]


def test_currency(spark):
    row = calls(spark, dict(provider="openai", completion=1_000_000))
    known = led.price_calls(row, price(spark, "openai", None), rates(spark, ("USD", 7.0)))
    assert cost(known) == [pytest.approx(31.5)]
    for bad in (rates(spark, ("EUR", 7.0)), rates(spark, ("USD", 0.0))):
        assert led.price_calls(row, price(spark, "openai", None), bad).first().priced is False


def test_reprice_only_touches_what_had_no_price(spark):
    rows = calls(spark, dict(completion=1_000_000), dict(model="new", completion=1_000_000))
    first = led.price_calls(rows, price(spark), rates(spark, ("USD", 7.0)))
    dearer = spark.createDataFrame([("deepseek", "m", 100.0, 1.0, 100.0, "CNY", 1.0), ("deepseek", "new", 1.0, 1.0, 4.5, "CNY", 1.0)], PRICES_DDL)
    again = led.reprice(first, dearer, rates(spark, ("USD", 7.0)))
    assert cost(again) == [4.5, 4.5]
    assert cost(led.reprice(again, dearer, rates(spark, ("USD", 7.0)))) == [4.5, 4.5]


def test_usage_reports(spark):
    samples = [
        ({"prompt_tokens": 9, "completion_tokens": 2, "prompt_cache_hit_tokens": 4}, (9, 2, 4)),
        ({"prompt_tokens": 9, "prompt_tokens_details": {"cached_tokens": 3}}, (9, 0, 3)),
        ({"prompt_cache_hit_tokens": 0, "prompt_tokens_details": {"cached_tokens": 3}}, (0, 0, 0)),
        ({"prompt_cache_hit_tokens": None, "prompt_tokens_details": {"cached_tokens": 3}}, (0, 0, 3)),
        ({"prompt_cache_hit_tokens": "x", "prompt_tokens_details": {"cached_tokens": 3}}, (0, 0, 0)),
        ({"prompt_cache_hit_tokens": -2}, (0, 0, 0)), ({}, (0, 0, 0)),
    ]
    rows = spark.createDataFrame([(i, json.dumps(u)) for i, (u, _) in enumerate(samples)], "i int, usage string")
    got = {r.i: (r.prompt, r.completion, r.cached) for r in led.usage_tokens(rows).collect()}
    assert got == {i: w for i, (_, w) in enumerate(samples)}


def test_doubtful_prices_are_dropped(spark):
    models = {
        "ok": {"input": 1, "output": 2}, "text": {"input": "two", "output": 2}, "high": {"input": 50000, "output": 2}, "odd": 3,
        "str": {"input": "1.5", "cached_input": 0.1, "output": 2, "peak_multiplier": 2}, "mult": {"input": 1, "output": 2, "peak_multiplier": 11},
        "neg": {"input": -1, "output": 2}, "none": {"output": 2},
    }
    rows = spark.createDataFrame([("openai", "Here:\n" + json.dumps({"models": models, "note": "n" * 300}) + "\nbye"), ("openai", "no json"), ("openai", "{broken}")], "provider string, reply string")
    got = {r.model: (r.input, r.cached_input, r.output, r.peak_multiplier, r.currency, len(r.note)) for r in led.extract_prices(rows).collect()}
    assert got == {"ok": (1.0, 1.0, 2.0, 1.0, "USD", 300), "str": (1.5, 0.1, 2.0, 2.0, "USD", 300), "mult": (1.0, 1.0, 2.0, 1.0, "USD", 300)}


def test_excerpt(spark):
    long = "x" * 9000 + "price" + "y" * 9000
    samples = [("short price", "short price"), (long, long[8500:16500]), ("z" * 9000, "z" * 8000), ("$" + "q" * 9000, "$" + "q" * 7999)]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(samples)], "i int, t string")
    got = {r.i: r.e for r in rows.select("i", led.price_excerpt("t", 8000).alias("e")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(samples)}


def test_stale_lists(spark):
    prices = spark.createDataFrame([("openai", "a", 1000), ("deepseek", "m", 1000)], "provider string, model string, updated_at bigint")
    wanted = spark.createDataFrame([("openai", "a"), ("openai", "b"), ("deepseek", "m"), ("ollama", "x"), ("moonshot", "k")], "provider string, model string")
    got = {r.provider: r.stale for r in led.stale_prices(wanted, prices, 1000 + led.MAX_AGE).collect()}
    assert got == {"openai": True, "deepseek": False, "ollama": False, "moonshot": True}
    assert {r.provider: r.stale for r in led.stale_prices(wanted, prices, 1001 + led.MAX_AGE).collect()}["deepseek"] is True


def test_days_and_months_are_local(spark):
    rows = calls(spark, dict(ts=dt.datetime(2024, 1, 31, 23, 30, tzinfo=dt.timezone.utc), completion=1_000_000), dict(ts=dt.datetime(2024, 2, 1, 0, 30, tzinfo=dt.timezone.utc), completion=1_000_000))
    ledger = led.price_calls(rows, price(spark), rates(spark, ("USD", 7.0)))
    as_of = F.to_timestamp(F.lit("2024-02-01 12:00:00"))
    t = led.spend_totals(ledger, as_of).first()
    assert (t.total, t.month, t.today) == (9.0, 4.5, 4.5)
    assert [(r.day, r.cny) for r in led.daily_spend(ledger, as_of).collect()] == [("2024-01-31", 4.5), ("2024-02-01", 4.5)]


def test_days_and_months_begin_at_local_midnight(spark):
    """New York, the night the clocks go forward: 2024-03-10 has 23 hours, from 05:00 to 04:00 UTC."""
    rows = [("2024-03-10 04:59:59", 1.0), ("2024-03-10 05:00:00", 2.0), ("2024-03-11 03:59:59", 4.0), ("2024-03-11 04:00:00", 8.0), ("2024-03-01 04:59:00", 16.0)]
    ledger = spark.createDataFrame(rows, "ts string, cny double").select(
        F.col("ts").cast("timestamp").alias("ts"), "cny", F.lit(1).alias("prompt"), F.lit(1).alias("completion"), F.lit(True).alias("priced")
    )
    zone = "America/New_York"
    days = {r.day: r.cny for r in led.daily_spend(ledger, F.lit("2024-03-12").cast("timestamp"), zone=zone).collect()}
    assert days == {"2024-02-29": 16.0, "2024-03-09": 1.0, "2024-03-10": 6.0, "2024-03-11": 8.0}
    t = led.spend_totals(ledger, F.lit("2024-03-11 03:30:00").cast("timestamp"), zone).first()
    assert (t.total, t.month, t.today) == (31.0, 15.0, 14.0)  # today began at 05:00 UTC on the 10th
    u = led.spend_totals(ledger, F.lit("2024-03-11 03:30:00").cast("timestamp")).first()
    assert (u.month, u.today) == (31.0, 12.0)
