"""What model calls cost: metering, prices, currency, totals.

A call without a known price or rate stays unpriced and is counted apart, so a total is a floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Billing currency of each provider.
CURRENCIES = {"deepseek": "CNY", "openai": "USD", "moonshot": "CNY", "siliconflow": "CNY", "ollama": "CNY"}
# Providers that cost nothing.
FREE_PROVIDERS = ("ollama",)
# Bounds of a believable price, multiplier and exchange rate; age of a stale price list.
MAX_PRICE = 10_000.0
MAX_MULTIPLIER = 10.0
FX_BOUNDS = (1.0, 100.0)
MAX_AGE = 7 * 24 * 3600
EXCERPT_BEFORE = 500
MONEY_WORDS = r"元|USD|\$|price|Price|价格|百万|1M tokens|per million"


def _whole(value: Column) -> Column:
    """A number from JSON text as a whole number; null where it is none."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def usage_tokens(rows: DataFrame, usage: str = "usage") -> DataFrame:
    """Prompt, completion and cached tokens from either vendor's usage report.

    The top-level spelling of cached tokens wins where it is not null, even if it is unreadable.
    """
    prompt = _whole(F.get_json_object(usage, "$.prompt_tokens"))
    completion = _whole(F.get_json_object(usage, "$.completion_tokens"))
    top = F.get_json_object(usage, "$.prompt_cache_hit_tokens")
    nested = F.get_json_object(usage, "$.prompt_tokens_details.cached_tokens")
    hit = F.when(top.isNotNull(), _whole(top)).otherwise(_whole(nested))
    zero = F.lit(0)
    return (
        rows.withColumn("prompt", F.coalesce(prompt, zero))
        .withColumn("completion", F.coalesce(completion, zero))
        .withColumn("cached", F.greatest(zero, F.coalesce(hit, zero)))
    )


def uncached() -> Column:
    """Input tokens billed at the full rate: the reported total holds the cached ones too."""
    return F.greatest(F.lit(0), F.col("prompt") - F.col("cached"))


def default_currency(provider: str | Column = "provider") -> Column:
    col = F.col(provider) if isinstance(provider, str) else provider
    pairs = [F.lit(v) for kv in CURRENCIES.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), F.lit("CNY"))


def with_prices(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``input``, ``cached_input``, ``output``, ``currency`` and ``peak_multiplier``; null
    where the model has no price. The price list is left to the broadcast threshold."""
    p = prices.select(
        "provider", "model", "input", F.coalesce("cached_input", "input").alias("cached_input"), "output",
        F.coalesce(F.when(F.col("currency") != "", F.col("currency")), default_currency()).alias("currency"),
        F.coalesce("peak_multiplier", F.lit(1.0)).alias("peak_multiplier"),
    ).where("input IS NOT NULL AND output IS NOT NULL")
    joined = calls.join(p, ["provider", "model"], "left")
    free = F.col("provider").isin(*FREE_PROVIDERS)
    return (
        joined.withColumn("input", F.when(free, 0.0).otherwise(F.col("input")))
        .withColumn("cached_input", F.when(free, 0.0).otherwise(F.col("cached_input")))
        .withColumn("output", F.when(free, 0.0).otherwise(F.col("output")))
        .withColumn("currency", F.when(free, "CNY").otherwise(F.col("currency")))
        .withColumn("peak_multiplier", F.when(free, 1.0).otherwise(F.col("peak_multiplier")))
    )


def with_fx(priced: DataFrame, fx: DataFrame) -> DataFrame:
    """Add ``fx``, the rate of the price's currency to yuan; null where none is known."""
    rates = fx.where("rate > 0").select("currency", F.col("rate").alias("_rate"))
    return priced.join(rates, "currency", "left").withColumn(
        "fx", F.when(F.col("currency") == "CNY", 1.0).otherwise(F.col("_rate"))
    ).drop("_rate")


def is_peak(ts: str | Column = "ts") -> Column:
    """Weekdays 9 to 12 and 14 to 18 by the clock at UTC+8."""
    there = F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, "+08:00")
    hour = F.hour(there)
    return (F.weekday(there) < 5) & (((hour >= 9) & (hour < 12)) | ((hour >= 14) & (hour < 18)))


def price_calls(calls: DataFrame, prices: DataFrame, fx: DataFrame) -> DataFrame:
    """The ledger: cost in yuan, the rates it was worked out at, and whether it could be priced."""
    rows = with_fx(with_prices(calls, prices), fx)
    m = F.when(is_peak(), F.col("peak_multiplier")).otherwise(1.0)
    known = F.col("input").isNotNull() & F.col("fx").isNotNull()
    cost = F.col("fx") * (
        m * F.col("input") * uncached() + m * F.col("cached_input") * F.col("cached") + m * F.col("output") * F.col("completion")
    ) / 1e6

    def stored(value: Column) -> Column:
        return F.when(known, value).otherwise(0.0)

    return rows.select(
        *calls.columns, stored(cost).alias("cny"), known.alias("priced"),
        stored(m * F.col("input") * F.col("fx")).alias("rate_in"),
        stored(m * F.col("cached_input") * F.col("fx")).alias("rate_cached"),
        stored(m * F.col("output") * F.col("fx")).alias("rate_out"),
    )


def reprice(ledger: DataFrame, prices: DataFrame, fx: DataFrame) -> DataFrame:
    """Price the calls that had no price; what was priced before is history and stays."""
    fresh = [c for c in ledger.columns if c not in ("cny", "priced", "rate_in", "rate_cached", "rate_out")]
    done = ledger.where("priced")
    again = price_calls(ledger.where("NOT priced").select(*fresh), prices, fx)
    return done.unionByName(again.select(*ledger.columns))


def local(at: Column, zone: str) -> Column:
    """The wall clock of ``zone`` at an instant, for a session in UTC."""
    return F.from_utc_timestamp(at, zone)


def local_start(unit: str, at: Column, zone: str) -> Column:
    """The instant at which the local ``unit`` (day, month) began."""
    return F.to_utc_timestamp(F.date_trunc(unit, local(at, zone)), zone)


def spend_totals(ledger: DataFrame, as_of: Column, zone: str = "UTC") -> DataFrame:
    """All the totals in one pass. Bounds are the local midnights of ``zone``, summer time included."""
    month, day = local_start("month", as_of, zone), local_start("day", as_of, zone)

    def spent(since: Column | None = None) -> Column:
        value = F.col("cny") if since is None else F.when(F.col("ts") >= since, F.col("cny"))
        return F.round(F.coalesce(F.sum(value), F.lit(0.0)), 4)

    return ledger.agg(
        spent().alias("total"), spent(month).alias("month"), spent(day).alias("today"),
        F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion"), F.lit(0)).alias("completion_tokens"),
        F.count_if(~F.col("priced")).alias("unpriced_calls"), F.unix_timestamp(F.min("ts")).alias("since"),
    )


def first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def unpriced_models(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Models without a price, by name; all of them unless a report asks for the first few."""
    return first_rows(ledger.where("NOT priced").select("model").distinct().orderBy("model"), limit)


def spend_by_model(ledger: DataFrame, limit: int | None = None) -> DataFrame:
    """Where the money went; ties are broken by model and kind."""
    rows = ledger.groupBy("model", "kind").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cny").alias("_cny"),
        F.sum("prompt").alias("prompt_tokens"), F.sum("completion").alias("completion_tokens"),
    )
    top = first_rows(rows.orderBy(F.col("_cny").desc(), "model", "kind"), limit)
    return top.withColumn("cny", F.round("_cny", 4)).drop("_cny")


def daily_spend(ledger: DataFrame, as_of: Column, days: int | None = None, zone: str = "UTC") -> DataFrame:
    """Cost per local day of ``zone``, over all time or the last ``days``; days without cost are left out."""
    rows = ledger.where("cny > 0")
    if days is not None:
        rows = rows.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    per_day = rows.groupBy(F.date_format(local(F.col("ts"), zone), "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("cny"), 4).alias("cny"))
    return per_day.orderBy("day")


def price_excerpt(text: str | Column, most: int | None = None) -> Column:
    """What a page says about money: the whole text, or, where a model takes no more than ``most``
    characters, that many from a little before the first money word."""
    col = F.col(text) if isinstance(text, str) else text
    at = F.regexp_instr(col, F.lit(MONEY_WORDS))
    start = F.when(at > 0, F.greatest(at - EXCERPT_BEFORE, F.lit(1))).otherwise(F.lit(1))
    return col if most is None else F.when(F.length(col) <= most, col).otherwise(F.substring(col, start, most))


_ENTRY = T.MapType(T.StringType(), T.StringType())
_EXTRACTION = T.StructType([
    T.StructField("models", T.MapType(T.StringType(), T.StringType())),
    T.StructField("note", T.StringType()),
    T.StructField("_bad", T.StringType()),
])


def _sane(value: Column) -> Column:
    number = F.btrim(value).try_cast("double")
    return F.when(number.between(0.0, MAX_PRICE), number)


def extract_prices(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Validated prices from model replies; anything doubtful is dropped, nothing is guessed.

    One row per model whose input and output prices are believable. Needs ``provider``.
    """
    keys = [c for c in replies.columns if c != reply]
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, _EXTRACTION, {"columnNameOfCorruptRecord": "_bad"})
    read = replies.withColumn("_x", parsed).where(F.col("_x._bad").isNull())
    rows = read.select(*keys, F.col("_x.note").alias("_note"), F.explode("_x.models").alias("model", "_entry"))
    entry = rows.withColumn("_e", F.from_json("_entry", _ENTRY))
    low, high = _sane(F.col("_e")["input"]), _sane(F.col("_e")["output"])
    cached, multiplier = _sane(F.col("_e")["cached_input"]), _sane(F.col("_e")["peak_multiplier"])
    return entry.select(
        *keys, "model", low.alias("input"), F.coalesce(cached, low).alias("cached_input"), high.alias("output"),
        F.when(multiplier.between(1.0, MAX_MULTIPLIER), multiplier).otherwise(1.0).alias("peak_multiplier"),
        default_currency().alias("currency"), F.coalesce("_note", F.lit("")).alias("note"),
    ).where("input IS NOT NULL AND output IS NOT NULL")


PRICE_COLUMNS = ["provider", "model", "input", "cached_input", "output", "updated_at"]


def merge_prices(feed: DataFrame) -> DataFrame:
    """The newest row per provider and model; models not seen again stay. ``feed_id`` settles a tie."""
    newest = F.max_by(F.struct("input", "cached_input", "output", "updated_at"), F.struct("updated_at", "feed_id"))
    return feed.groupBy("provider", "model").agg(newest.alias("_p")).select("provider", "model", "_p.*")


def price_status(feed: DataFrame) -> DataFrame:
    """Per provider: last update, its source, the last note that was not empty, and the models."""
    at = F.struct("updated_at", "feed_id")
    noted = F.col("note") != ""
    return feed.groupBy("provider").agg(
        F.max("updated_at").alias("updated_at"), F.max_by("source", at).alias("source"),
        F.coalesce(F.max_by(F.when(noted, F.col("note")), F.when(noted, at)), F.lit("")).alias("note"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"),
    )


def stale_prices(wanted: DataFrame, prices: DataFrame, now: int, max_age: int = MAX_AGE) -> DataFrame:
    """Providers whose list must be read again: never read, too old, or a wanted model without a
    price. Free ones never are. ``wanted`` is (provider, model)."""
    ages = prices.groupBy("provider").agg(F.max("updated_at").alias("updated_at"))
    models = wanted.where(F.coalesce(F.col("model"), F.lit("")) != "").distinct()
    missing = models.join(prices.select("provider", "model"), ["provider", "model"], "left_anti")
    lacking = missing.groupBy("provider").agg(F.count(F.lit(1)).alias("missing"))
    rows = wanted.select("provider").distinct().join(ages, "provider", "left").join(lacking, "provider", "left")
    old = F.col("updated_at").isNull() | (F.lit(now) - F.col("updated_at") > max_age)
    stale = ~F.col("provider").isin(*FREE_PROVIDERS) & (old | F.col("missing").isNotNull())
    return rows.select("provider", stale.alias("stale"), F.coalesce("missing", F.lit(0)).alias("missing"))


def fx_pick(quotes: DataFrame, by: str) -> DataFrame:
    """The first source, by ``source_rank``, whose rate is believable."""
    low, high = FX_BOUNDS
    good = quotes.where((F.col("rate") > low) & (F.col("rate") < high))
    return good.groupBy(by).agg(F.min_by("rate", "source_rank").alias("rate"), F.min("source_rank").alias("source_rank"))


def usage_rollup(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("prompt_tokens"),
        F.sum("completion").alias("completion_tokens"), F.sum("cached").alias("cached_tokens"),
        (F.sum("prompt") + F.sum("completion")).alias("total"),
    )


def model_list(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Models the provider lists together with those known to work."""
    return listed.select("model").union(known.select("model")).distinct().orderBy("model")
