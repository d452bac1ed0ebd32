"""Line deduplication against levelled sorted runs of line hashes.

The store holds runs: tables of one row per line key, bucketed and sorted by the key's hash. A new
batch of documents is reduced to one row per key, merge-anti-joined with every run to tell new keys
from known ones, and written as a run of level 0. When a level holds ``fanout`` runs they are merged
into one of the next level. Runs and batches meet bucket by bucket, so no run is shuffled again.

Only DataFrame functions are used here.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.base import lasting, partitions, text_hash
from quire.session import forgotten, recorded_path, remove_path, work_path

KEY = ["h1", "h2"]
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered."""
    return F.translate(F.btrim(line, F.lit(BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hash(line: Column, least: int) -> Column:
    """128-bit hash of the line's key; null for keys under ``least`` code points."""
    key = line_key(line)
    h1, h2 = text_hash(key)
    return F.when(F.length(key) >= least, F.struct(h1.alias("h1"), h2.alias("h2")))


def text_lines(text: str) -> Column:
    """Lines of a text; none counts as one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def hashed_lines(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2): every long line key of a document once."""
    keys = F.array_distinct(F.transform(text_lines(text_col), lambda x: key_hash(x, least)))
    one = docs.select(F.col(id_col).alias("doc_id"), F.explode(keys).alias("k")).where("k IS NOT NULL")
    return one.select("doc_id", "k.h1", "k.h2")


class LineRuns:
    """Levelled sorted runs in the shared folder: rows (h1, h2, n_docs, top_doc, fresh)."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = recorded_path(work_path(self.spark, name))
        (
            rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", self.paths[name]).format("parquet").saveAsTable(name)
        )
        return name

    def _drop(self, name: str) -> None:
        """A run nobody needs any more, its files included."""
        self.spark.sql(f"DROP TABLE {name}")
        remove_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all runs; what was read from them has to be written by then."""
        for name in list(self.paths):
            self._drop(name)
        self.levels = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, hashed: DataFrame) -> DataFrame:
        """Take in a batch of (doc_id, h1, h2) and return its run; ``fresh`` marks keys in no earlier
        run. Every document belongs to one batch only, so counts of documents add up."""
        docs = hashed.distinct()
        batch = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))
        runs = self.runs()
        if runs:
            batch = lasting(batch.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY), "line_batch")
            fresh = reduce(lambda rows, run: rows.join(run.hint("merge"), KEY, "left_anti"), runs, batch)
            marked = fresh.select(*KEY, F.lit(True).alias("fresh"))
            batch = batch.join(marked.hint("merge"), KEY, "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
        else:
            batch = batch.withColumn("fresh", F.lit(True))
        self.levels[0].append(name := self._write(batch.select(*KEY, "n_docs", "top_doc", "fresh")))
        self._compact()
        return self.spark.table(name) if name in self.levels[0] else self.spark.table(self.levels[-1][-1])

    def _compact(self) -> None:
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fanout:
                merged = self._write(merge_runs([self.spark.table(n) for n in self.levels[at]]))
                for name in self.levels[at]:
                    self._drop(name)
                self.levels[at] = []
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(merged)
            at += 1

    def totals(self) -> DataFrame:
        """One row per key over all runs."""
        return merge_runs(self.runs()) if self.runs() else self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, top_doc long, fresh boolean")


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """One run of several: sorted runs are joined in full, bucket by bucket, and counts add up."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.hint("merge").withColumnsRenamed({"n_docs": "_n", "top_doc": "_top", "fresh": "_fresh"})
        zero, no = F.lit(0), F.lit(False)
        return a.join(b, KEY, "full").select(
            *KEY, (F.coalesce("n_docs", zero) + F.coalesce("_n", zero)).alias("n_docs"),
            F.greatest("top_doc", "_top").alias("top_doc"), (F.coalesce("fresh", no) | F.coalesce("_fresh", no)).alias("fresh"),
        )

    return reduce(two, runs)


def marked_lines(
    docs: DataFrame, least: int = 40, documents: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_row, _text, _n_lines, _kept, _n_dropped): every row of ``docs`` as a struct, with its text, the
    lines that stay and the counts. Lines that at least ``documents`` documents share go.

    A key of at least ``least`` code points found in that many documents loses its lines everywhere
    but in the largest id that holds it; all its lines stay there. Documents are told apart by id:
    rows with the same id are one document (each row keeps its own result, and a pair of equal rows
    gives two equal rows); a missing id is one more document, below every number. A null or empty
    text is one empty line, never dropped. An empty table gives no rows. Other columns are not read.

    The corpus goes through the runs in ``batches`` parts, split by a hash of the id. Only hashes are
    shuffled there, counted before the shuffle, so a line in a third of all documents is one row per
    task. The texts move once, to meet the list of their own dropped keys.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    hashes = lasting(hashed_lines(docs, least, id_col, text_col), "line_hashes")
    store = LineRuns(spark)
    for k in range(batches):
        store.add(hashes.where(part == k))
    common = store.totals().where(F.col("n_docs") >= documents).select(*KEY, "top_doc")
    gone = (
        hashes.join(common, KEY).where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
        .groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    )
    gone = lasting(gone, "gone_lines")
    store.close()
    forgotten(hashes)
    # the columns ride in a struct of their own, so that their names meet none of the work's
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    lines = text_lines("_text")
    kept = F.when(F.col("_gone").isNull(), lines).otherwise(
        F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("_gone"), key_hash(x, least)), F.lit(True)))
    )
    # by a merge at every size: the lists grow with the texts, so none is made to be held by every task
    joined = rows.join(gone.hint("merge"), rows._id.eqNullSafe(gone._gone_id), "left")
    out = joined.select("_row", "_text", F.size(lines).cast("bigint").alias("_n_lines"), kept.alias("_kept"))
    return out.withColumn("_n_dropped", (F.col("_n_lines") - F.size("_kept")).cast("bigint"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped) of every row by :func:`marked_lines`."""
    done = marked_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **rule)
    return done.select(
        F.col("_row.doc_id").alias("doc_id"), F.array_join("_kept", "\n").alias("kept"),
        F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
    )


def replaced(docs: DataFrame, text_col: str = "text", **rule: int) -> DataFrame:
    """``docs`` with every column, whatever its name, the texts without their dropped lines. Null
    texts stay null; all else as in :func:`marked_lines`."""
    done = marked_lines(docs, text_col=text_col, **rule)
    text = F.when(F.col("_n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("_text"))
    return done.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    done = drop_repeated_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS l,
               generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)
), common AS (
  SELECT k, max(doc_id) AS top FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT lines.*, common.k IS NOT NULL AND lines.doc_id <> common.top AS gone FROM lines LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, E'\n' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
