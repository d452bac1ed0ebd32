"""What the operators share: session settings, lasting intermediate tables, split remainders and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.sources.corpus import table  # noqa: F401  (read by the query modules)

#: Whole texts ride in Arrow batches, so a batch is kept to a few MB of ordinary documents.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on. Joins with a hot key are split while they run."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def lasting(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, so a lost executor costs no work done before."""
    return session.written(df, name)


def partitions(spark: SparkSession) -> int:
    """Tasks of one shuffle, as the session sets it for the size of its tables."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def same(a: Column, b: Column) -> Column:
    """Equal, with null equal to null: ids may be missing."""
    return a.eqNullSafe(b)


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_hash(*cols: str | Column) -> list[Column]:
    """Two 64-bit hashes of the same values, taken together as a 128-bit identity."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


#: Bits of a key filter at most, 8 MB, and bits for each key.
FILTER_BITS, KEY_BITS = 1 << 26, 16


def key_filter(keys: DataFrame, col: str) -> tuple[bytes, int] | None:
    """A bitmap of hashed keys and its number of bits, to pass over rows whose key cannot be among them
    before they are read further; a few others are let through. None where there are too many keys for
    ``FILTER_BITS``: then rows have to be joined. Packed on Spark, so that its bytes alone come here."""
    bits = 1 << 16
    n = keys.count()
    while bits < KEY_BITS * n:
        bits *= 2
    if bits > FILTER_BITS:
        return None
    piece = 1 << 16

    def packed(t: pa.Table) -> pa.Table:
        at = t.column("at").to_numpy()
        out = np.zeros(piece, np.uint8)
        out[at % piece] = 1
        return pa.table([pa.array([int(at[0]) // piece]), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["piece", "b"])

    at = keys.select(filter_place(col, bits).alias("at")).distinct().withColumn("p", F.shiftright("at", 16))
    out = bytearray(bits // 8)
    for r in at.groupBy("p").applyInArrow(packed, "piece bigint, b binary").collect():
        out[r.piece * piece // 8 : (r.piece + 1) * piece // 8] = r.b
    return bytes(out), bits


def filter_place(col: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(bits)).cast("bigint")


def may_be_among(places: np.ndarray, known: bytes) -> np.ndarray:
    """Whether the bits at ``places`` are set."""
    table = np.frombuffer(known, np.uint8)
    return (table[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``links`` (columns ``a`` and ``b``): rows (node, component_id), the
    smallest node reachable, for every node that has a link.

    Large stars and small stars in turn: every node points at the smallest node of its
    neighbourhood until nothing changes, in about log(n) rounds. A round keeps at most one link for
    each one before, is written to the shared folder, and only a count comes to the driver. The
    smallest neighbour is a ``min`` with map-side combine and joined back, so a node that a third
    of all links touch is no single task.
    """
    spark = links.sparkSession
    a_, b_ = F.col(a), F.col(b)
    edges = lasting(
        links.where(a_ != b_).select(F.greatest(a_, b_).alias("u"), F.least(a_, b_).alias("v")).distinct(), "links"
    )

    def star(pairs: DataFrame, larger_only: bool) -> DataFrame:
        both = pairs if larger_only else pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if larger_only:  # u and its smaller neighbours all point at the smallest
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        else:  # the larger neighbours of u point at the smallest
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where(F.col("u") != F.col("v")).distinct()

    before = None
    for _ in range(rounds):
        edges = lasting(star(star(edges, False), True), "links")
        # stable when every link points at a node that itself points nowhere
        now = edges.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle; raise rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)
