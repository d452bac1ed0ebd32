"""Queries on the spend ledger and the price list, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import session
from quire.functions import text as tx
from quire.operators import ledger as led
from quire.operators import memory as mem
from quire.operators import refresh
from quire.oracles import base as o
from quire.oracles import tables  # noqa: F401 - registers the views
from quire.plans.queries_catalog import _HTML
from quire.sources import derived
from quire.sources.corpus import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = o.with_views(sql, *needs)
        return fn

    return keep


def usage_reports(spark, sf):
    """Every call's usage as one vendor or another reports it, some of it odd."""
    c = derived.calls(spark, sf)
    shape = F.col("call_id") % 5
    tail = F.concat(F.lit('{"prompt_tokens":'), F.col("prompt"), F.lit(',"completion_tokens":'), F.col("completion"))
    k = F.col("cached")
    usage = (
        F.when(shape == 0, F.concat(tail, F.lit(',"prompt_cache_hit_tokens":'), k, F.lit("}")))
        .when(shape == 1, F.concat(tail, F.lit(',"prompt_tokens_details":{"cached_tokens":'), k, F.lit("}}")))
        .when(shape == 2, F.concat(tail, F.lit(',"prompt_cache_hit_tokens":-5,"prompt_tokens_details":{"cached_tokens":9}}')))
        .when(shape == 3, F.concat(tail, F.lit(',"prompt_cache_hit_tokens":null,"prompt_tokens_details":{"cached_tokens":'), k, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"completion_tokens":'), F.col("completion"), F.lit(',"prompt_cache_hit_tokens":"none"}')))
    )
    return c.select("call_id", usage.alias("usage"))


@query(
    "usage_tokens",
    """SELECT call_id, CASE WHEN call_id % 5 = 4 THEN 0 ELSE prompt END AS prompt, completion,
         CASE WHEN call_id % 5 IN (0, 1, 3) THEN cached ELSE 0 END AS cached FROM calls""",
    "calls",
)
def usage_tokens(spark, sf):
    return led.usage_tokens(usage_reports(spark, sf)).select("call_id", "prompt", "completion", "cached")


@query("uncached_tokens", "SELECT call_id, greatest(0, prompt - cached) AS uncached FROM calls", "calls")
def uncached_tokens(spark, sf):
    return derived.calls(spark, sf).select("call_id", led.uncached().alias("uncached"))


@query(
    "price_lookup",
    """SELECT call_id, CASE WHEN c.provider = 'ollama' THEN 0e0 ELSE p.input END AS input,
         CASE WHEN c.provider = 'ollama' THEN 0e0 ELSE p.cached_input END AS cached_input,
         CASE WHEN c.provider = 'ollama' THEN 0e0 ELSE p.output END AS output,
         CASE WHEN c.provider = 'ollama' THEN 'CNY' ELSE p.currency END AS currency
       FROM calls c LEFT JOIN prices p USING (provider, model)""",
    "calls", "prices",
)
def price_lookup(spark, sf):
    priced = led.with_prices(derived.calls(spark, sf), derived.prices(spark))
    return priced.select("call_id", "input", "cached_input", "output", "currency")


@query("fx_rate", "SELECT call_id, fx FROM priced_calls", "priced_calls")
def fx_rate(spark, sf):
    priced = led.with_prices(derived.calls(spark, sf), derived.prices(spark))
    return led.with_fx(priced, derived.fx(spark)).select("call_id", "fx")


@query(
    "peak_window",
    """SELECT event_id, isodow(ts + INTERVAL 8 HOUR) <= 5 AND (hour(ts + INTERVAL 8 HOUR) BETWEEN 9 AND 11
         OR hour(ts + INTERVAL 8 HOUR) BETWEEN 14 AND 17) AS peak FROM events""",
)
def peak_window(spark, sf):
    return table(spark, sf, "events").select("event_id", led.is_peak().alias("peak"))


def ledger(spark, sf):
    return led.price_calls(derived.calls(spark, sf), derived.prices(spark), derived.fx(spark))


_MONEY = "round(cny, 11) AS cny, round(rate_in, 11) AS rate_in, round(rate_cached, 11) AS rate_cached, round(rate_out, 11) AS rate_out"


def rounded(df):
    return df.select("call_id", "priced", *[F.round(c, 11).alias(c) for c in ("cny", "rate_in", "rate_cached", "rate_out")])


@query("price_calls", f"SELECT call_id, priced, {_MONEY} FROM priced_calls", "priced_calls")
def price_calls(spark, sf):
    return rounded(ledger(spark, sf))


@query(
    "reprice",
    f"""SELECT call_id, priced, {_MONEY} FROM priced_calls WHERE provider NOT IN ('deepseek', 'moonshot')
        UNION ALL SELECT call_id, true, round(cny, 11), round(rate_in, 11), round(rate_cached, 11), round(rate_out, 11)
        FROM priced_calls WHERE provider = 'moonshot'
        UNION ALL SELECT call_id, true, round(cny / 2, 11), round(rate_in / 2, 11), round(rate_cached / 2, 11), round(rate_out / 2, 11)
        FROM priced_calls WHERE provider = 'deepseek'""",
    "priced_calls",
)
def reprice(spark, sf):
    """First priced at half of the first provider's rates and none of the others', then again."""
    full = derived.prices(spark)
    half = [F.when(F.col("provider") == "deepseek", F.col(c) / 2).otherwise(F.col(c)).alias(c) for c in ("input", "cached_input", "output")]
    early = full.where("provider = 'deepseek'").select("provider", "model", *half, "currency", "peak_multiplier")
    first = led.price_calls(derived.calls(spark, sf), early, derived.fx(spark))
    return rounded(led.reprice(first, full, derived.fx(spark)))


AS_OF = "2024-01-15 12:00:00"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


@query(
    "spend_totals",
    f"""SELECT round(sum(cny), 4) AS total, round(coalesce(sum(cny) FILTER (ts >= date_trunc('month', TIMESTAMP '{AS_OF}')), 0), 4) AS month,
          round(coalesce(sum(cny) FILTER (ts >= date_trunc('day', TIMESTAMP '{AS_OF}')), 0), 4) AS today, count(*) AS calls,
          sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens,
          count(*) FILTER (NOT priced) AS unpriced_calls, min(epoch) AS since FROM priced_calls""",
    "priced_calls",
)
def spend_totals(spark, sf):
    return led.spend_totals(ledger(spark, sf), as_of())


@query("unpriced_models", "SELECT DISTINCT model FROM priced_calls WHERE NOT priced", "priced_calls")
def unpriced_models(spark, sf):
    return led.unpriced_models(ledger(spark, sf))


@query(
    "spend_by_model",
    """SELECT model, kind, count(*) AS calls, round(sum(cny), 4) AS cny, sum(prompt)::BIGINT AS prompt_tokens,
         sum(completion)::BIGINT AS completion_tokens FROM priced_calls GROUP BY 1, 2""",
    "priced_calls",
)
def spend_by_model(spark, sf):
    return led.spend_by_model(ledger(spark, sf))


@query(
    "daily_spend",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(cny), 4) AS cny FROM priced_calls
        WHERE cny > 0 GROUP BY 1""",
    "priced_calls",
)
def daily_spend(spark, sf):
    return led.daily_spend(ledger(spark, sf), as_of())


_PAGE_TEXT = f"SELECT page_id, {_HTML} || CASE WHEN page_id % 5 = 0 THEN repeat(' pad', 1500) || ' price list ' || repeat('tail ', 2000) ELSE '' END AS text FROM pages"


@query(
    "price_excerpt",
    f"SELECT page_id, text AS excerpt FROM ({_PAGE_TEXT})",
)
def price_excerpt(spark, sf):
    pages = table(spark, sf, "pages")
    extra = F.concat(F.repeat(F.lit(" pad"), F.lit(1500)), F.lit(" price list "), F.repeat(F.lit("tail "), F.lit(2000)))
    text = F.concat(tx.html_to_text("html"), F.when(F.col("page_id") % 5 == 0, extra).otherwise(""))
    return pages.select("page_id", text.alias("text")).select("page_id", led.price_excerpt("text").alias("excerpt"))


def price_replies(spark, sf):
    """What a model reads off a price page, one reply per published row, some of it wrong."""
    p = derived.price_feed(spark, sf)
    n = F.col("feed_id")
    number = lambda c: F.col(c).cast("string")
    low = F.when(n % 11 == 0, F.lit('"two"')).when(n % 13 == 0, F.lit("50000")).otherwise(number("input"))
    body = F.concat(
        F.lit('{"models": {"'), F.col("model"), F.lit('": {"input": '), low,
        F.when(F.col("cached_input").isNotNull(), F.concat(F.lit(', "cached_input": '), number("cached_input"))).otherwise(""),
        F.lit(', "output": '), number("output"), F.lit(', "peak_multiplier": '), (n % 15).cast("string"),
        F.lit('}, "bad": 3}, "note": "'), F.repeat(F.col("note"), F.lit(30)), F.lit('"}'),
    )
    reply = F.when(n % 17 == 0, F.lit("I could not find a price")).when(n % 7 == 0, F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone"))).otherwise(body)
    return p.select("feed_id", "provider", reply.alias("reply"))


@query(
    "extract_prices",
    """SELECT feed_id, model, input, coalesce(cached_input, input) AS cached_input, output,
         CASE WHEN feed_id % 15 BETWEEN 1 AND 10 THEN (feed_id % 15)::DOUBLE ELSE 1e0 END AS peak_multiplier, 'CNY' AS currency,
         repeat(note, 30) AS note
       FROM price_feed WHERE feed_id % 17 <> 0 AND feed_id % 11 <> 0 AND feed_id % 13 <> 0""",
    "price_feed",
)
def extract_prices(spark, sf):
    return led.extract_prices(price_replies(spark, sf)).drop("provider")


@query(
    "merge_prices",
    """SELECT provider, model, arg_max(input, (updated_at, feed_id)) AS input,
         arg_max_null(cached_input, (updated_at, feed_id)) AS cached_input,
         arg_max(output, (updated_at, feed_id)) AS output, max(updated_at) AS updated_at FROM price_feed GROUP BY 1, 2""",
    "price_feed",
)
def merge_prices(spark, sf):
    return led.merge_prices(derived.price_feed(spark, sf))


o.view("wanted", """
SELECT provider, model FROM calls UNION ALL
SELECT 'brand#' || (c_custkey % 27), 'm' || (c_custkey % 5) FROM customer
""", "calls")


NOW = derived.EPOCH + 55 * 86400


@query(
    "stale_prices",
    f"""SELECT provider, provider <> 'ollama' AND (updated_at IS NULL OR {NOW} - updated_at > 604800 OR missing IS NOT NULL) AS stale,
          coalesce(missing, 0) AS missing
        FROM (SELECT DISTINCT provider FROM wanted) LEFT JOIN (SELECT provider, max(updated_at) AS updated_at FROM price_feed GROUP BY 1) USING (provider)
        LEFT JOIN (SELECT provider, count(*) AS missing FROM (SELECT DISTINCT provider, model FROM wanted) w
          WHERE NOT EXISTS (SELECT 1 FROM price_feed f WHERE f.provider = w.provider AND f.model = w.model) GROUP BY 1) USING (provider)""",
    "price_feed", "wanted",
)
def stale_prices(spark, sf):
    return led.stale_prices(wanted(spark, sf), led.merge_prices(derived.price_feed(spark, sf)), NOW)


def wanted(spark, sf):
    c = F.col("c_custkey")
    buyers = table(spark, sf, "customer").select(
        F.concat(F.lit("brand#"), (c % 27).cast("string")).alias("provider"), F.concat(F.lit("m"), (c % 5).cast("string")).alias("model")
    )
    return derived.calls(spark, sf).select("provider", "model").unionByName(buyers)


@query(
    "price_status",
    """SELECT provider, max(updated_at) AS updated_at, arg_max(source, (updated_at, feed_id)) AS source,
         coalesce(arg_max(note, (updated_at, feed_id)) FILTER (note <> ''), '') AS note,
         array_to_string(list_sort(list_distinct(list(model))), ',') AS models FROM price_feed GROUP BY 1""",
    "price_feed",
)
def price_status(spark, sf):
    return led.price_status(derived.price_feed(spark, sf))


@query(
    "fx_pick",
    """SELECT day, arg_min(value, event_id) AS rate, min(event_id) AS source_rank
       FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE value > 1 AND value < 100 GROUP BY 1""",
)
def fx_pick(spark, sf):
    """Quotes of a day are tried in order until one is believable."""
    quotes = table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("value").alias("rate"), F.col("event_id").alias("source_rank")
    )
    return led.fx_pick(quotes, "day")


@query(
    "usage_rollup",
    """SELECT conv_id, count(*) AS calls, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens,
         sum(cached)::BIGINT AS cached_tokens, (sum(prompt) + sum(completion))::BIGINT AS total FROM calls GROUP BY 1""",
    "calls",
)
def usage_rollup(spark, sf):
    return led.usage_rollup(derived.calls(spark, sf), "conv_id")


@query("model_list", "SELECT DISTINCT model FROM calls UNION SELECT model FROM price_feed", "calls", "price_feed")
def model_list(spark, sf):
    return led.model_list(derived.calls(spark, sf), derived.price_feed(spark, sf))


o.view("excerpts", "SELECT page_id, length(text) AS chars, excerpt FROM (" + f"SELECT page_id, text, text AS excerpt FROM ({_PAGE_TEXT})" + ")")


def rate_reader(prompt: str) -> str:
    """A stand-in for the model that reads a price page: counts the money words it was shown."""
    import json

    n = prompt.count("price") + prompt.count("USD")
    return json.dumps({"models": {"m0": {"input": n % 90 + 1, "output": 2 * (n % 90 + 1)}}, "note": "read"})


@query(
    "refresh_prices",
    f"""SELECT page_id, 'm0' AS model, (n % 90 + 1)::DOUBLE AS input, (2 * (n % 90 + 1))::DOUBLE AS output FROM (
          SELECT page_id, ((length(excerpt) - length(replace(excerpt, 'price', ''))) // 5
            + (length(excerpt) - length(replace(excerpt, 'USD', ''))) // 3) AS n
          FROM excerpts)""",
    "excerpts",
)
def refresh_prices(spark, sf):
    """Pages worth reading → excerpt → one model call per page → validated prices."""
    pages = table(spark, sf, "pages")
    extra = F.concat(F.repeat(F.lit(" pad"), F.lit(1500)), F.lit(" price list "), F.repeat(F.lit("tail "), F.lit(2000)))
    text = F.concat(tx.html_to_text("html"), F.when(F.col("page_id") % 5 == 0, extra).otherwise(""))
    rows = pages.select("page_id", F.lit("deepseek").alias("provider"), text.alias("text"))
    asked = rows.select("page_id", "provider", led.price_excerpt("text").alias("prompt"))
    read = led.extract_prices(mem.batch_infer(asked, rate_reader).drop("call_error"))
    return read.select("page_id", "model", "input", "output")


@query(
    "daily_spend_local",
    "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, round(sum(cny), 4) AS cny FROM priced_calls WHERE cny > 0 GROUP BY 1",
    "priced_calls",
)
def daily_spend_local(spark, sf):
    """Cost per day as a clock in Shanghai shows it."""
    return led.daily_spend(ledger(spark, sf), as_of(), zone="Asia/Shanghai")


@query(
    "refresh_job",
    f"""SELECT provider, 'm0' AS model, (n % 90 + 1)::DOUBLE AS input, (2 * (n % 90 + 1))::DOUBLE AS output,
          {NOW} + CASE WHEN EXISTS (SELECT 1 FROM wanted w WHERE w.provider = p.provider AND w.model <> 'm0') THEN 86400 ELSE 0 END AS updated_at
        FROM (SELECT 'brand#' || page_id AS provider, chars, ((length(excerpt) - length(replace(excerpt, 'price', ''))) // 5
                + (length(excerpt) - length(replace(excerpt, 'USD', ''))) // 3) AS n FROM excerpts) p
        WHERE chars >= 200 AND EXISTS (SELECT 1 FROM wanted w WHERE w.provider = p.provider)""",
    "excerpts", "wanted",
)
def refresh_job(spark, sf):
    """Two batches of the price refresh a day apart: the second one asks about providers with a model that
    still has no price, all others keep what the first one read."""
    pages = table(spark, sf, "pages")
    extra = F.concat(F.repeat(F.lit(" pad"), F.lit(1500)), F.lit(" price list "), F.repeat(F.lit("tail "), F.lit(2000)))
    text = F.concat(tx.html_to_text("html"), F.when(F.col("page_id") % 5 == 0, extra).otherwise(""))
    named = pages.select(F.concat(F.lit("brand#"), F.col("page_id").cast("string")).alias("provider"), F.lit("page").alias("source"), text.alias("text"))
    quotes = spark.createDataFrame([("USD", 7.1, 0)], "currency string, rate double, source_rank int")
    book, log = refresh.PriceBook(spark, session.work_path(spark, "prices")), session.work_path(spark, "price-replies")
    for batch in range(2):
        state, _ = refresh.refresh(book, batch, wanted(spark, sf), named, quotes, rate_reader, NOW + 86400 * batch, log)
    return state.prices.select("provider", "model", "input", "output", "updated_at")
