"""The stages one after the other, each against its operator's rule on what the one before kept."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from .test_lines import brute  # noqa: E402
from .test_near import merge, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (10**9, "short", "en", "s", 5)], docs.schema)
    kept = {"start": docs.union(odd)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, [*kept.values()][-1], SF)
        out.write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert kept[name].columns == docs.columns, name
    rows = {n: [tuple(r) for r in d.select("doc_id", "text").collect()] for n, d in kept.items() if n != "tokens"}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {i for i, _ in rows["quality"]}
    judged = [(labels[i] == 1) == (i in ids) for i, _ in rows["start"] if i in labels]
    assert sum(judged) > 0.95 * len(judged)
    # null texts count as empty lines and stay null
    want = sorted((i, t) for i, t, _, _ in brute(rows["quality"]) if i is not None)
    assert sorted((i, t or "") for i, t in rows["lines"] if i is not None) == want
    sets = {i: shingles(t, 5) for i, t in rows["lines"] if i is not None}
    links = [(a, b) for a in sets for b in sets if a > b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = merge(sets, links)
    assert {i for i, _ in rows["near_duplicates"] if i is not None} == {i for i in sets if comp[i] == i}
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in rows["near_duplicates"] if not any(x in (t or "").lower() for x in items)}
    assert {i for i, _ in rows["decontamination"]} == clean
    assert kept["tokens"].count() == len(rows["decontamination"])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_are_judged_not_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    say = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    rows = [(None, f"{say('a')} {item} {say('b')}"), (None, say("clean")), (7, say("seven")), (7, item), (8, say("eight"))]
    kept = corpus_pipeline.without_leaks(spark, frame(rows), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, say("clean")), (7, say("seven")), (8, say("eight"))])
    near = f"{say('x')} more"
    rows = [(None, say("x")), (None, near), (5, near), (5, say("x")), (5, say("other")), (9, say("x")), (None, say("y")), (None, say("y")), (None, ""), (None, "")]
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, frame(rows), SF).collect()]
    assert len(kept) == 5 and {(5, say("other")), (None, say("y"))} <= {*kept} and kept.count((None, "")) == 2
    assert sum(i == 5 and t in (say("x"), near) for i, t in kept) == 1
