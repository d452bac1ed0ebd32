"""A corpus made ready for training, stage by stage. Every stage works on all rows of the one before.

What a stage returns has to be written before the next stage is called, as :func:`run` does: the next
one begins by removing the work tables that the one before was worked out from, so the shared folder
holds those of one stage at a time. Columns other than those of ``documents`` are left behind; null and
empty texts, missing and repeated ids, repeated rows and texts of any length are rows like others, and
an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, jaccard, leaks, lines, quality
from quire.llm.base import lasting, ready, table
from quire.llm.queries import vocabulary_path
from quire.session import forgotten, recorded, remove_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Work tables of the last stage called.
_left: list[str] = []


def stage(fn):
    """A stage that first removes the work tables of the one before."""

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ready(spark)
        while _left:
            remove_path(spark, _left.pop())
        with recorded() as paths:
            out = fn(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run_stage


@stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged. A row without an id is judged as any other."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model).select(*COLUMNS)


@stage
def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long lines that many documents share; a null text stays null."""
    return lines.replaced(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for each row, written so that it stays the same:
    ids may be missing or repeated, so rows are judged and dropped by this."""
    return lasting(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: that of smallest id, or any one where none has an
    id or several have that id; rows in no group, those without words among them, stay."""
    docs = numbered(docs)
    groups = jaccard.near_components(docs, k=5, percent=80, id_col="_row").where("n_shingles > 0")
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id")
    placed = lasting(groups.join(docs.select("_row", "doc_id"), "_row"), "groups")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row"))["_row"].alias("_first"))
    gone = placed.join(first, "component_id").where("_row != _first").select("_row")
    return docs.join(lasting(gone, "gone"), "_row", "left_anti").select(*COLUMNS)


@stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item is retold, each judged by its own text."""
    docs = numbered(docs)
    found = leaks.leaks(docs, table(spark, sf_dir, "benchmark"), id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return docs.join(lasting(found, "leaking"), "_row", "left_anti").select(*COLUMNS)


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of the texts, and digests of their ids and of the decoded text."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [
    ("quality", good_quality),
    ("lines", without_common_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_leaks),
    ("tokens", tokens),
]

#: The classifier and the retrieval are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for name, fn in STAGES[:-1]:
        before, docs = docs, lasting(fn(spark, docs, sf_dir), name)
        forgotten(before)  # the stage before is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
