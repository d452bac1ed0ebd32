"""Decks as files: a Python data source that reads them by declared format, and two ordered sinks.

    spark.dataSource.register(DeckFiles)
    spark.read.format("quire_files").load(folder)

A partition is a run of files of about ``run_bytes``. A file that cannot be read is a row with its
``error``, never a failed job. Paths are any that the Arrow file systems know; for a store that only
Spark reads, :func:`parsed` takes the rows of ``spark.read.format("binaryFile")`` and parses them alike.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, format string, n_bytes bigint, text string, error string"
RUN_BYTES, MAX_BYTES = 64 << 20, 200 << 20

# Why a file has no text.
UNSUPPORTED, TOO_LARGE = "unsupported format", "over the size limit"


def plain_text(data: bytes) -> str:
    """UTF-8, what is not is marked; line ends made uniform."""
    return data.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")


#: A reader for each format: the bytes of a file to its text. Add to it by :func:`source_with`.
READERS: dict[str, Callable[[bytes], str]] = {"md": plain_text, "markdown": plain_text, "txt": plain_text}


def format_of(path: str) -> str:
    """The ending in lower case; none where nothing stands before the dot."""
    stem, dot, ending = posixpath.basename(path).rpartition(".")
    return ending.lower() if dot and stem else ""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def parse(path: str, size: int, data: Callable[[], bytes], readers: dict, most: int) -> tuple:
    """(path, format, n_bytes, text, error) of one file."""
    kind = format_of(path)
    if kind not in readers:
        return path, kind, size, None, UNSUPPORTED
    if size > most:
        return path, kind, size, None, TOO_LARGE
    try:
        return path, kind, size, readers[kind](data()), None
    except Exception as bad:  # one bad file stops no other
        return path, kind, size, None, f"{type(bad).__name__}: {bad}"


class Run(InputPartition):
    """Files that one task reads, as (path, size)."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(len(files))
        self.files = files


class FilesReader(DataSourceReader):
    def __init__(self, options: dict, readers: dict):
        self.root, self.readers = options["path"], readers
        self.run_bytes, self.most = int(options.get("run_bytes", RUN_BYTES)), int(options.get("max_bytes", MAX_BYTES))

    def partitions(self) -> list[Run]:
        store, root = opened(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and not posixpath.basename(f.path).startswith((".", "_")))
        runs: list[list[tuple[str, int]]] = [[]]
        filled = 0
        for path, size in files:
            cost = min(size, self.most) + 4096  # opening a file costs as well
            if runs[-1] and filled + cost > self.run_bytes:
                runs.append([])
                filled = 0
            runs[-1].append((path, size))
            filled += cost
        return [Run(r) for r in runs if r]

    def read(self, partition: Run) -> Iterator[tuple]:
        if partition is None or not partition.files:
            return
        store, root = opened(self.root)
        for path, size in partition.files:

            def data(path: str = path) -> bytes:
                with store.open_input_stream(path) as f:
                    return f.read()

            yield (posixpath.relpath(path, root), *parse(path, size, data, self.readers, self.most)[1:])


class Done(WriterCommitMessage):
    pass


def replaced_by(store: fs.FileSystem, draft: str, final: str) -> None:
    """A finished file under its name; one of an earlier try of the same task gives way."""
    store.move(draft, final)


class FilesWriter(DataSourceWriter):
    """One file a row, by its relative ``path``. A file appears under its name when it is whole, and a
    task that is run again writes the same files again."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows: Iterator[Row]) -> Done:
        store, root = opened(self.root)
        made: set[str] = set()
        for row in rows:
            final = posixpath.join(root, row.path)
            folder = posixpath.dirname(final)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write((row.text or "").encode("utf-8", errors="replace"))
            replaced_by(store, draft, final)
        return Done()


class DeckFiles(DataSource):
    """Files below a folder, read by format; written one a row."""

    readers = READERS

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(self.options, self.readers)

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


def source_with(**readers: Callable[[bytes], str]) -> type[DeckFiles]:
    """The data source with further readers, or others for the formats it knows."""
    return type("DeckFiles", (DeckFiles,), {"readers": {**READERS, **readers}})


def read_decks(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(path, format, n_bytes, text, error) of every file below ``path``."""
    spark.dataSource.register(DeckFiles)
    return spark.read.format("quire_files").options(**options).load(path)


def write_decks(rows: DataFrame, path: str) -> None:
    """Rows (path, text) as files below ``path``."""
    rows.sparkSession.dataSource.register(DeckFiles)
    rows.select("path", "text").write.format("quire_files").mode("append").save(path)


def parsed(binaries: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """The same columns from rows (path, length, content) of Spark's own binary file reader."""
    known = readers or READERS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(p, n, lambda c=c: c, known, most) for p, n, c in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "format", "n_bytes", "text", "error"]
            )

    return binaries.select("path", "length", "content").mapInArrow(work, SCHEMA)


class DocumentsWriter(DataSourceWriter):
    """Rows (deck_id, page_index, last, json) in the order of deck and page, as JSON documents.

    A deck is a folder of its name whose files, in the order of their names, are together one JSON
    document: the first one opens it, the last one closes it, and each page is a line. A page is
    written as it arrives, so neither a deck nor a file is ever held.
    """

    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows: Iterator[Row]) -> Done:
        store, root = opened(self.root)
        deck, out, draft, final = None, None, "", ""

        def close() -> None:
            if out is not None:
                out.close()
                replaced_by(store, draft, final)

        for row in rows:
            if out is None or row.deck_id != deck:
                close()
                deck = row.deck_id
                folder = posixpath.join(root, quote("" if deck is None else str(deck), safe="") or "%")
                store.create_dir(folder, recursive=True)
                draft, final = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/part-{row.page_index:019d}.json"
                out = store.open_output_stream(draft)
            first = row.page_index == row.first
            opening = f'{{"deck_id":{json.dumps(deck, ensure_ascii=False)},"pages":[\n' if first else ","
            out.write(f"{opening}{row.json}\n{']}' + chr(10) if row.page_index == row.last else ''}".encode())
        close()
        return Done()


class DeckDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_documents"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentsWriter:
        return DocumentsWriter(self.options)


def export_decks(pages: DataFrame, path: str, tasks: int) -> None:
    """Pages (deck_id, page_index, json), one row a page, as one JSON document for each deck.

    Pages are dealt out by range of deck and page and sorted in each task, so a deck with a third of
    all pages is written by a third of the tasks, a file from each.
    """
    spark = pages.sparkSession
    spark.dataSource.register(DeckDocuments)
    ends = pages.groupBy("deck_id").agg(F.min("page_index").alias("first"), F.max("page_index").alias("last"))
    ended = pages.join(ends.withColumnRenamed("deck_id", "_deck"), F.col("deck_id").eqNullSafe(F.col("_deck"))).drop("_deck")
    order = ["deck_id", "page_index"]
    dealt = ended.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    dealt.select(*order, "first", "last", "json").write.format("quire_documents").mode("append").save(path)


def read_exported(spark: SparkSession, path: str, page: str) -> DataFrame:
    """(deck, page) of exported documents, ``page`` being the JSON schema of one, read line by line without
    putting a document together."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).withColumn("_file", F.input_file_name())
    body = lines.where("value <> ']}' AND NOT startswith(value, '{\"deck_id\":')")
    # the folder's name is quoted, and Spark quotes the path once more
    folder = F.url_decode(F.url_decode(F.element_at(F.split("_file", "/"), -2)))
    return body.select(folder.alias("deck"), F.from_json(F.regexp_replace("value", r"\A,", ""), page).alias("page"))
