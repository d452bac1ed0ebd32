"""Live feeds as Structured Streaming jobs whose final state equals the batch result.

Each job keeps its state in keyed aggregates, so late and repeated events are harmless and
partial aggregation runs before every shuffle. Changed rows are written per micro-batch in a
folder named by the batch number; a batch that is run again after a lost executor replaces its
own folder, so nothing is counted twice. The latest row of a key is its state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.streaming.decks import ROCKS


def page_state(events: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last whole page per key: each event carries a page, so replay changes nothing."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def glossary_state(proposals: DataFrame) -> DataFrame:
    """First rendering of a term by event order, not by arrival, and how often it was proposed."""
    from quire.operators.glossary import worded

    return (
        worded(proposals).groupBy("term")
        .agg(F.min_by("translation", "seq").alias("translation"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("count"))
    )


def spend_state(ledger: DataFrame) -> DataFrame:
    """Running totals per model and kind."""
    return ledger.groupBy("model", "kind").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cny").alias("cny"), F.sum("prompt").alias("prompt_tokens"),
        F.sum("completion").alias("completion_tokens"),
    )


def run_to_end(spark: SparkSession, state: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run a stateful query over all that is there and return the state it leaves.

    The checkpoint and the change log go to the shared folder.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # state off the heap
    out = session.work_path(spark, f"{name}-changes")

    def write(changes: DataFrame, batch: int) -> None:
        changes.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (
        state.writeStream.outputMode("update").queryName(f"{name}_{out[-8:]}")
        .option("checkpointLocation", session.work_path(spark, f"{name}-progress"))
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    changes = spark.read.schema(state.select("*", F.lit(0).cast("bigint").alias("_batch")).schema).parquet(f"{out}/batch=*")
    rest = [c for c in state.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_s"))
    return latest.select(*keys, "_s.*")


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """A folder of parquet files as an unbounded table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
