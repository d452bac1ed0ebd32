"""The classifiers on held-out labels, retrieval of leaks, and their odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import leaks, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    done = queries.QUERIES[name](spark, SF).where("held_out")
    rows = done.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    return np.array([r.predicted for r in rows]), np.array([r[label] for r in rows]), rows


def test_quality_on_held_out_labels(spark):
    predicted, truth, rows = held_out(spark, "op2_quality", "quality")
    assert (predicted == truth).mean() > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_labels(spark):
    predicted, truth, rows = held_out(spark, "op8_toxicity", "toxic")
    hit = (predicted & truth).sum()
    assert hit >= 0.7 * truth.sum() and hit >= 0.7 * predicted.sum()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)


ODD = [(1, None), (2, ""), (3, "   "), (None, "no id"), (4, "x" * 100_000), (5, "a b " * 30_000), (5, "again"), (6, "!!! $$$ 111")]


def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, 2) for i, t in ODD], "doc_id bigint, text string, score double, predicted int")


def test_classifiers_take_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    every = docs.union(odd(spark).select("doc_id", "text"))
    for run in (quality.classify, toxicity.score):
        got = run(every, labels)
        assert got.count() == every.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        # without labels of both kinds nothing is known
        assert {r.score for r in run(odd(spark), labels.limit(0)).collect()} == {0.5}
        assert run(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_distances_are_those_of_the_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)), rng.normal(1, 2, size=(300, 3))]
    n = np.array([len(v) for v in x], float)
    model = quality.Discriminant.of(n, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), shrink=0.0, ridge=0.0)
    at = rng.normal(size=(5, 3))
    log = []
    for v, m in zip(x, n):
        c = (v - v.mean(0)).T @ (v - v.mean(0)) / m
        d = at - v.mean(0)
        log.append(np.log((m + 1) / (n.sum() + 2)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.score(at), 1 / (1 + np.exp(log[0] - log[1])))


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t ІDІОТ i​diot $tupid") == " idiot idiot idiot stupid "
    lexicon = toxicity.Lexicon(((" bad", 2.0), (" badge ", 0.0), (" bad luck ", 0.0), (" badly ", 3.0)))
    assert lexicon.measure("Bad badge badly b4d") == (7.0, 2, 4)
    assert lexicon.measure("bad luck") == (0.0, 0, 2)
    assert lexicon.measure(None) == (0.0, 0, 0)


def test_leaks_are_the_planted_ones(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_leaks"](spark, SF).collect()}
    inside = F.contains(F.lower("d.text"), F.lower("i.text"))
    want = {(r.doc_id, r.item_id) for r in docs.alias("d").join(items.alias("i"), inside).select("doc_id", "item_id").collect()}
    assert got == want and want


def test_leaks_by_paraphrase_and_odd_rows(spark):
    items = spark.createDataFrame([(1, "the red fox crossed a frozen river near the old mill before dawn came", 0), (2, None, 0), (3, "", 0)], "item_id bigint, text string, doc_id int")
    told = "At night the red fox slowly crossed a frozen river near the mill, long before dawn came."
    rows = [(1, told), (2, "the river and the mill are old"), (None, f"{'filler words here ' * 400}{told} {'and more ' * 300}"), *[(i, t) for i, t in ODD if i]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, item_id int")
    got = leaks.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (None, 1)}
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_short_items_beside_a_long_one(spark):
    """One long item must not hide short ones that stand word for word in long documents."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    lengths = [2000, 300, 90, 40, 15, 15, 15, 9, 6, 4, 2, 1]
    items = [(j, say(n) if n > 2 else " ".join(f"only{n}{k}" for k in range(n))) for j, n in enumerate(lengths)]
    docs = [(j, f"{say(1500)} {t} {say(1500)}") for j, t in items] + [(100 + i, say(2000)) for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = leaks.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    full = {(r.doc_id, r.item_id) for r in got if r.in_order == 1 and r.answer == 1}
    assert {(j, j) for j in range(len(items))} <= full
    # a long text keeps only what its own passage retells
    assert not any(r.doc_id >= 100 and r.in_order == 1 and lengths[r.item_id] > 4 for r in got)


def test_common_order_is_the_longest_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = (rng.integers(0, 5, rng.integers(1, 30)).tolist() for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leaks.common_order(a, b) == table[-1][-1]


def test_columns_of_any_name_and_ids_that_repeat(spark):
    rows = [(i, "you vile wretch" if i % 2 else "a kind word") for i in range(200)] + [(1, "you vile wretch")] * 50
    df = spark.createDataFrame([(i, t, 1, 2, "l") for i, t in rows], "doc_id bigint, text string, y int, part int, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    got = toxicity.score(df, labels).collect()
    assert len(got) == 250 and all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in got)
