"""Price lists kept up to date: an incremental job that asks only providers whose prices are stale, merges
what it reads, and keeps its state by batch number, so that a batch that is run again replaces itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.operators import calls as mc
from quire.operators import ledger as led
from quire.operators.memory import ModelCall

PRICES = "provider string, model string, input double, cached_input double, output double, updated_at bigint, source string, note string"
RATES = "currency string, rate double, updated_at bigint"
#: A page shorter than this is no price list.
LEAST_PAGE = 200


@dataclass(frozen=True)
class State:
    """Prices and exchange rates as of a batch."""

    prices: DataFrame
    rates: DataFrame


class PriceBook:
    """The state of the job in a shared folder, a sub-folder for each batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def before(self, batch: int) -> State:
        """The state that the last finished batch before this one left; empty at first."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in range(batch - 1, -1, -1):
            done = jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch={n}/done")
            if done.getFileSystem(conf).exists(done):
                read = lambda name, ddl: self.spark.read.schema(ddl).parquet(f"{self.root}/batch={n}/{name}")  # noqa: B023, E731
                return State(read("prices", PRICES), read("rates", RATES))
        return State(self.spark.createDataFrame([], PRICES), self.spark.createDataFrame([], RATES))

    def write(self, batch: int, state: State) -> State:
        """Both tables, then the mark that makes the batch count."""
        at = f"{self.root}/batch={batch}"
        state.prices.write.mode("overwrite").parquet(f"{at}/prices")
        state.rates.write.mode("overwrite").parquet(f"{at}/rates")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{at}/done")
        return self.before(batch + 1)


def merged_prices(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest row of every provider and model; models that were not seen again stay."""
    names = ["input", "cached_input", "output", "updated_at", "source", "note"]
    newest = F.max_by(F.struct(*names), F.struct("updated_at", "source")).alias("_p")
    return old.unionByName(fresh).groupBy("provider", "model").agg(newest).select("provider", "model", "_p.*")


def refresh(
    book: PriceBook, batch: int, wanted: DataFrame, pages: DataFrame, quotes: DataFrame, complete: ModelCall, now: int, log: str,
    max_age: int = led.MAX_AGE,
) -> tuple[State, DataFrame]:
    """One run of the job: the state it leaves, and the providers it asked about.

    ``wanted`` (provider, model) are models that are used, ``pages`` (provider, source, text) the pages that
    name prices, ``quotes`` (currency, rate, source_rank) offered rates. Only pages of stale providers are
    read, through the logged pool of model calls. A call that fails, or a page in which no believable price
    stands, leaves its provider as it was. A rate is taken from the first source that is believable; where
    there is none, or nothing was asked, the old one is kept.
    """
    before = book.before(batch)
    stale = session.written(led.stale_prices(wanted, before.prices, now, max_age).where("stale"), "stale")
    open_pages = pages.where(F.length("text") >= LEAST_PAGE).join(stale.select("provider"), "provider", "left_semi")
    names = wanted.where(F.coalesce("model", F.lit("")) != "").groupBy("provider").agg(F.array_join(F.sort_array(F.collect_set("model")), ", ").alias("_m"))
    asked = open_pages.join(names, "provider", "left").select(
        "provider", "source",
        F.concat(
            F.lit("Vendor: "), "provider", F.lit("\nModels in use: "), F.coalesce("_m", F.lit("")), F.lit("\n\nThe pricing page, as text:\n\n"),
            led.price_excerpt("text"),
        ).alias("prompt"),
    )
    asked = session.written(asked, "asked")
    replies = mc.infer_logged(asked, complete, log).where("call_error IS NULL").select("provider", "source", "reply")
    read = led.extract_prices(replies).withColumn("updated_at", F.lit(now).cast("bigint"))
    fresh = session.written(read.select([f.split()[0] for f in PRICES.split(", ")]), "fresh_prices")
    rates = before.rates
    if not fresh.isEmpty():
        picked = led.fx_pick(quotes, "currency").select("currency", "rate", F.lit(now).cast("bigint").alias("updated_at"))
        rates = rates.join(picked.select("currency"), "currency", "left_anti").unionByName(picked)
    state = book.write(batch, State(merged_prices(before.prices, fresh), rates))
    return state, asked.select("provider").distinct()
