"""Decks as files: read by format, written in order; hierarchies of any depth."""

from __future__ import annotations

import json
import random
from pathlib import Path
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as cat
from quire.sources import files


def test_files_are_read_by_format_and_bad_ones_are_rows(spark, tmp_path):
    rows = [("a/1.md", "x\r\ny\rz"), ("a/2.txt", None), ("a/b/3.KEY", "k"), ("4.markdown", "ä" * 10), ("noending", "n")]
    files.write_decks(spark.createDataFrame(rows, "path string, text string"), str(tmp_path))
    (tmp_path / "bad.md").write_bytes(b"ok \xff end")
    (tmp_path / ".hidden.md").write_bytes(b"h")
    got = {r.path: (r.format, r.text, r.error) for r in files.read_decks(spark, str(tmp_path)).collect()}
    assert got == {
        "a/1.md": ("md", "x\ny\nz", None), "a/2.txt": ("txt", "", None), "a/b/3.KEY": ("key", None, files.UNSUPPORTED),
        "4.markdown": ("markdown", "ä" * 10, None), "noending": ("", None, files.UNSUPPORTED), "bad.md": ("md", "ok � end", None),
    }
    small = {r.path: r.error for r in files.read_decks(spark, str(tmp_path), max_bytes=10).collect()}
    assert small["4.markdown"] == files.TOO_LARGE and small["a/1.md"] is None
    assert files.read_decks(spark, str(tmp_path), run_bytes=1).rdd.getNumPartitions() == 6
    assert files.read_decks(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    # the same rules over what Spark's own reader gives
    binaries = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    other = {Path(r.path).name: (r.text, r.error) for r in files.parsed(binaries).collect()}
    assert other["1.md"] == ("x\ny\nz", None) and other["noending"][1] == files.UNSUPPORTED


def test_a_reader_of_ones_own_that_fails_stops_nothing(spark, tmp_path):
    def upper(data: bytes) -> str:
        if data == b"no":
            raise ValueError("cannot read")
        return data.decode().upper()

    for name, text in (("1.key", "deck"), ("2.key", "no"), ("3.md", "plain")):
        (tmp_path / name).write_text(text)
    spark.dataSource.register(files.source_with(key=upper))
    got = {r.path: (r.text, r.error) for r in spark.read.format("quire_files").load(str(tmp_path)).collect()}
    assert got == {"1.key": ("DECK", None), "2.key": (None, "ValueError: cannot read"), "3.md": ("plain", None)}


def test_files_written_twice_are_the_same_files(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i % 3}/{i}.md", f"text {i}") for i in range(30)], "path string, text string")
    for _ in range(2):
        files.write_decks(df, str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.endswith(".crc")) == sorted(f"{i}.md" for i in range(30))


def test_an_empty_folder(spark, tmp_path):
    assert files.read_decks(spark, str(tmp_path)).count() == 0


def test_decks_are_one_document_each_written_by_many_tasks(spark, tmp_path):
    hot, deck = F.lit("hot/é +"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))
    pages = spark.range(400).select(
        F.when(F.col("id") < 300, hot).otherwise(deck).alias("deck_id"), (F.col("id") * 2 + 5).alias("page_index"),
        F.to_json(F.struct((F.col("id") * 2 + 5).alias("index"), F.lit('a "quoted"\nline').alias("text"))).alias("json"),
    )
    files.export_decks(pages.repartition(7), str(tmp_path), 6)
    parts = {}
    for folder in tmp_path.iterdir():
        if folder.is_dir():
            found = sorted(folder.glob("part-*.json"))
            doc = json.loads("".join(p.read_text() for p in found))
            assert doc["deck_id"] == unquote(folder.name)
            parts[doc["deck_id"]] = len(found)
            want = [r.page_index for r in pages.where(F.col("deck_id") == doc["deck_id"]).orderBy("page_index").collect()]
            assert [p["index"] for p in doc["pages"]] == want and doc["pages"][0]["text"] == 'a "quoted"\nline'
    assert set(parts) == {"hot/é +", "d0", "d1", "d2"} and parts["hot/é +"] > 2
    back = files.read_exported(spark, str(tmp_path), "index bigint, text string")
    assert back.select("deck", "page.index").exceptAll(pages.select("deck_id", "page_index")).count() == 0 and back.count() == 400


def walked(nodes):
    """Paths by walking up from every node."""
    by_id = {i: (p, n) for i, p, n in nodes}
    out = {}
    for i in by_id:
        names, seen, at = [], set(), i
        while at in by_id and at not in seen:
            seen.add(at)
            names.append(by_id[at][1])
            at = by_id[at][0]
        out[i] = ("/".join(reversed(names)), len(names))
    return out


NODES = "id bigint, parent bigint, name string"


@pytest.mark.parametrize("seed", range(2))
def test_paths_with_cycles_strangers_and_odd_names(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, rng.choice([None, rng.randrange(60), rng.randrange(60), i - 1, 999]), rng.choice(["a", "b/c", "", "ü"]) + str(i)) for i in range(60)]
    nodes += [(100, 100, "self"), (101, 102, "x"), (102, 103, "y"), (103, 101, "z"), (104, 102, "below")]
    got = {r.id: (r.path, r.levels) for r in cat.hierarchy_paths(spark, spark.createDataFrame(nodes, NODES)).collect()}
    assert got == walked(nodes)
    counted = {r.id: r.levels for r in cat.hierarchy_paths(spark, spark.createDataFrame(nodes, NODES), text=False).collect()}
    assert counted == {i: n for i, (_, n) in walked(nodes).items()}
    assert cat.hierarchy_paths(spark, spark.createDataFrame([], NODES)).count() == 0


def test_a_chain_of_100_000_and_as_many_under_one_root(spark):
    n = F.col("id")
    chain = spark.range(100_000).select("id", F.when(n > 0, n - 1).alias("parent"), F.lit("c").alias("name"))
    wide = spark.range(100_000, 200_000).select("id", F.when(n > 100_000, F.lit(100_000)).cast("bigint").alias("parent"), F.lit("w").alias("name"))
    got = cat.hierarchy_paths(spark, chain.union(wide), text=False)
    wrong = got.where((n < 100_000) & (F.col("levels") != n + 1) | (n > 100_000) & (F.col("levels") != 2))
    assert got.count() == 200_000 and wrong.count() == 0
