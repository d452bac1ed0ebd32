"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; all can be changed on a running session.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when that costs the next operator one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A join on whole pages may use a partitioning by part of its keys, so page tables that are
    # spread by (deck, shard) already are joined where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Recursive queries walk whole tables; the default stops at a million rows.
    "spark.sql.cteRecursionRowLimit": "-1",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on (UTC) and the skew handling of AQE."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names one.
    Where none is named, a local master gets a fresh folder under /tmp and any other is refused:
    executors would each write to a disk of their own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one run of one job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it ends.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: worked out once, read by column after that,
    and safe from lost executors. For tables that are wide or read several times; its size is
    known to the planner."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    # once the table is written nobody reads the shuffles it was made by again
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    recorded_path(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def written_by_key(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The same as a table bucketed by ``keys``, so that a join by them reads it where it lies and deals out
    its other side alone. ``df`` is best dealt out by the same keys already."""
    spark = df.sparkSession
    path, table = recorded_path(work_path(spark, name)), f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.table(table)
    out.written_path = path
    return out


#: Paths written in the scopes that are open just now, the innermost last.
_scopes: list[list[str]] = []


def recorded_path(path: str) -> str:
    """Note a folder of our own in the innermost open scope."""
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove one of our own folders, through the file system it lies in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forgotten(df: DataFrame) -> None:
    """Remove a table made by :func:`written` that nothing reads any more; any other is left alone."""
    path = getattr(df, "written_path", None)
    if path:
        remove_path(df.sparkSession, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of the work tables written inside the block, for :func:`remove_path` later."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        _scopes.pop()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside the block are removed at its end, so what leaves it has to be worked
    out or written by then. Nothing is removed after an error: the next try may look at it."""
    with recorded() as paths:
        yield
    for path in paths:
        remove_path(spark, path)
