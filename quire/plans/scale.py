"""Plan shapes that stay bounded when one key holds a third of all rows.

A plain ``row_number() over (partition by k order by o)`` puts a whole key into one task. The
helpers here split every key into shards of at most ``span`` rows, rank inside a shard, and add
the row count of the shards before it. Only the per-shard counts are ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import session

# Rows of one key that one task ranks. 1024 documents of a few KB are a few MB.
SPAN = 1024
# Copies made of the small side of a join whose large side may have a hot key.
SALTS = 16


def shard_of(order: str | Column, span: int = SPAN) -> Column:
    """Whole-number division by ``span``, a power of two."""
    col = F.col(order) if isinstance(order, str) else order
    return F.shiftright(col.cast("bigint"), span.bit_length() - 1)


def sharded_rank(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    out: str,
    *,
    start: int = 1,
    span: int = SPAN,
    shard: str = "shard",
) -> DataFrame:
    """``row_number`` of ``order`` within ``group``, ``order`` being a whole number unique in it.

    The result keeps ``shard`` and is partitioned by (group, shard), so windows that add more
    keys to those reuse the same exchange.
    """
    keyed = df.withColumn(shard, shard_of(order, span))
    counts = (
        df.select(*group, order)
        .withColumn(shard, shard_of(order, span))
        .groupBy(*group, shard)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.partitionBy(*group).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, shard, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # the window leaves the offsets dealt out by group alone, and a join may follow the dealing of either
    # side: dealt out anew, so that the rows are not brought to them by group
    offsets = offsets.repartition(*group, shard)
    inside = Window.partitionBy(*group, shard).orderBy(order)
    return (
        keyed.join(offsets, [*group, shard])
        .withColumn(out, F.row_number().over(inside) + F.col("_before") + F.lit(start - 1))
        .drop("_before")
    )


def sharded_running_total(
    df: DataFrame, group: Sequence[str], order: str, value: str, out: str, *, span: int = SPAN
) -> DataFrame:
    """Sum of ``value`` over the rows before this one in ``group``; one row per (group, order)."""
    keyed = df.withColumn("_shard", shard_of(order, span))
    totals = keyed.groupBy(*group, "_shard").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*group).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_shard", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    offsets = offsets.repartition(*group, "_shard")  # as in sharded_rank
    inside = (
        Window.partitionBy(*group, "_shard").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.join(offsets, [*group, "_shard"])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_offset", "_shard")
    )


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """``df`` with its place in the order of all rows, from 0, written so that it stays.

    Rows are dealt out by range and numbered in each task; only the number of rows of each task is
    added up in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = session.written(placed, "ranked")
    # the id holds the task in its upper bits and the row of the task in the lower 33
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row a task
    return ranked.withColumn(out, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_before")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_from: str | Column,
    *,
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join a large left side, hot in ``on``, to a right side with few rows per key.

    The right side is copied once per salt; left rows take a salt from ``salt_from``.
    """
    salt = F.col(salt_from) if isinstance(salt_from, str) else salt_from
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # a right side that is dealt out by fewer keys would have the left side follow it there
    copies = copies.repartition(*on, "_salt")
    salted = left.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts)))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
