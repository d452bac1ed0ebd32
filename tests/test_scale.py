from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.plans import scale


def hot(spark, n=20_000):
    """Half of all rows have one key; ids have gaps and run below zero."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))).alias("k"),
        (F.col("id") * 3 - 7000).alias("at"), (F.col("id") % 5).alias("v"),
    )


def test_sharded_rank_equals_row_number(spark):
    df = hot(spark)
    got = scale.sharded_rank(df, ["k"], "at", "r", span=1024)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("at")))
    assert got.select("k", "at", "r").exceptAll(want.select("k", "at", "r")).count() == 0
    assert got.count() == df.count()


def test_sharded_rank_puts_no_key_into_one_group(spark):
    got = scale.sharded_rank(hot(spark), ["k"], "at", "r", span=1024)
    assert got.groupBy("k", "shard").count().agg(F.max("count")).first()[0] <= 1024


def test_sharded_running_total(spark):
    df = hot(spark)
    got = scale.sharded_running_total(df, ["k"], "at", "v", "t", span=512)
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.select("k", "at", "t").exceptAll(want.select("k", "at", "t")).count() == 0


def test_joins_agree(spark):
    left, right = hot(spark, 3000), hot(spark, 3000).select("k").distinct().withColumn("n", F.length("k"))
    plain = left.join(right, "k", "left").select("k", "at", "n")
    other = scale.salted_join(left, right, ["k"], "at")
    assert other.select("k", "at", "n").exceptAll(plain).count() == 0 and other.count() == 3000


def test_rows_follow_no_side_that_is_dealt_out_by_key_alone(spark):
    """Only counts by key are brought together by key; rows of a hot key stay spread by shard or salt."""
    import re

    from quire.session import prepare

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    prepare(spark).conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = hot(spark)
        sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        for got in (
            scale.sharded_rank(df, ["k"], "at", "r"), scale.sharded_running_total(df, ["k"], "at", "v", "t"),
            scale.salted_join(df, sizes, ["k"], "at"),
        ):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(k#\d+, \d+\)", plan)) == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_page_work_shares_one_exchange(spark):
    """Ranking pages, exploding them and windows over whole pages need one shuffle of the text."""
    from quire.operators import classify as cl
    from quire.sources import views

    df = cl.classified_blocks(views.blocks(spark, "/root/testdata/sf0.001"), views.deck_sizes(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("SortMergeJoin", 1)
    # the windows over pages stand on the join without another exchange, and what the join reads of
    # the texts was dealt out by deck and shard once
    assert "Exchange" not in above, plan
    assert below.index("Exchange hashpartitioning(deck_id") < below.index("FileScan"), plan
    assert below[: below.index("FileScan")].count("Exchange hashpartitioning") == 1, plan


def test_blocks_are_worked_out_from_one_reading_of_the_texts(spark):
    """Counting repeated text reads the pages that the blocks come from: one scan of the texts, one exchange."""
    from quire.plans import stages

    df = stages.classified(spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) <= 3 and sum("text#" in line for line in scans) == 1, plan
    assert "ReusedExchange" in plan


def test_folding_plain_text_costs_little_more_than_lower_case(spark):
    import time

    from quire.functions import text as tx

    rows = spark.range(400_000).select(F.concat(F.lit("Some Plain WORDS "), "id").alias("t")).repartition(4).cache()
    rows.count()

    def seconds(column):
        best = 99.0
        for _ in range(4):
            began = time.perf_counter()
            rows.select(column.alias("f")).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    lower, folded = seconds(F.lower("t")), seconds(tx.fold_case("t"))
    rows.unpersist()
    assert folded < 1.5 * lower + 0.3, (lower, folded)


def test_a_global_rank_is_the_order_of_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("string").alias("k")).distinct()
    got = scale.global_rank(df, ["k"], "r")
    want = df.withColumn("w", F.row_number().over(Window.orderBy("k")) - 1)
    assert got.join(want, "k").where("r <> w").count() == 0 and got.count() == df.count()


def test_a_hot_deck_is_ranked_and_ordered_like_any_other(spark, tmp_path):
    """One deck with two thirds of all pages, spread over several shards."""
    from quire.operators import selection as sel
    from quire.operators import segmentation as sg
    from quire.sources import views

    docs = spark.range(0, 12_000, 2).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Page "), F.col("id").cast("string"), F.lit(". It ends.")).alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 5).cast("string"))).alias("source"),
        F.lit(1).cast("bigint").alias("n_chars"),
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages = views.paged_documents(spark, str(tmp_path))
    plain = Window.partitionBy("deck_id").orderBy("doc_id")
    assert pages.where("deck_id = 'hot'").select("shard").distinct().count() > 2
    assert pages.withColumn("want", F.row_number().over(plain) - 1).where("want <> page_index").count() == 0
    lines = pages.select(*views.PAGE, F.lit(0).cast("bigint").alias("block_index"), F.lit("body").alias("kind"), "text")
    order = sel.screen_order(sg.sentences(lines))
    want = Window.partitionBy("deck_id").orderBy("page_index", "sent_index")
    assert order.withColumn("want", F.row_number().over(want) - 1).where("want <> position").count() == 0
    assert order.count() == 12_000
