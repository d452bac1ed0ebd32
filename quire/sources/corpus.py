"""Readers for the tables and files the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File endings that can be read as decks.
READABLE_FORMATS = ("docx", "markdown", "md", "pdf", "ppt", "pptx")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table, with the schema its files have now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{md,markdown,txt}") -> DataFrame:
    """Text files below a folder, one row per file, with line ends made uniform."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    )
    return files.withColumn("text", F.regexp_replace("text", r"\r\n?", "\n"))


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Any files below a folder as bytes, for readers that turn them into pages."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "modificationTime", "length", "content")
    )


def json_rows_tolerant(rows: DataFrame, column: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """Parse a JSON column; rows that do not parse or miss a required field are left out."""
    bad = "_bad"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json(F.col(column), wide, {"columnNameOfCorruptRecord": bad})
    keep = F.col(f"_row.{bad}").isNull()
    for name in required:
        keep = keep & F.col(f"_row.{name}").isNotNull()
    names = [F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields]
    others = [c for c in rows.columns if c != column and c not in schema.names]
    return rows.withColumn("_row", parsed).where(keep).select(*others, *names)


def write_json(df: DataFrame, path: str) -> None:
    """Nested JSON sink, one document per line."""
    df.write.mode("errorifexists").json(path)
