"""Jaccard joins and near vectors against comparing everything."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from quire.llm import jaccard, vectors
from quire.llm.base import components


def merge(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def family(rng, size, edits, n):
    """A text and copies with a few words changed each."""
    base = [f"w{rng.randint(0, 400)}" for _ in range(n)]
    out = [base]
    for _ in range(size):
        copy = [*base]
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(n)] = f"e{rng.randint(0, 9999)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def texts():
    rng = random.Random(9)
    out = [*family(rng, 60, 9, 300), *family(rng, 20, 3, 80), *family(rng, 12, 1, 25), *family(rng, 5, 40, 2500)]
    chain = [f"c{i}" for i in range(240)]  # every text links with the next, the ends do not
    for i in range(12):
        out.append(" ".join(chain))
        chain = chain[4:] + [f"d{i}-{j}" for j in range(4)]
    out += ["", None, " \n", "one", "ONE", "one two", "one  TWO\t", "two one", "a b c", "A b\x0bC", "a b c d"]
    return out + out[:4]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_components_of_all_pairs(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    data = texts()
    sets = [shingles(t, k) for t in data]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and sets[j]:
                links.append((i, j))
    want = {i: (len(sets[i]), c) for i, c in merge(range(len(data)), links).items()}
    df = spark.createDataFrame([(i, t, -1, -1) for i, t in enumerate(data)], "doc_id bigint, text string, component_id int, node int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, k, percent).collect()}
    assert got == want


def test_ids_missing_or_repeated(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (7, long), (9, long + " x"), (None, "alone here"), (9, "other text of nine"), (11, "other text of nine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.near_components(df).collect())
    assert got == sorted([("None", 48, "7"), ("7", 48, "7"), ("9", 49, "7"), ("None", 1, "None"), ("9", 2, "7"), ("11", 2, "7")])
    assert jaccard.near_components(df.limit(0)).count() == 0


def test_sets_in_neighbouring_bands_share_a_key():
    rng = np.random.default_rng(3)
    tiles = jaccard.Tiles(90)
    for n in [1, 2, 5, 9, 10, 19, 20, 60, 200, 999, 3000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, len(a) // 15 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 15 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(np.intersect1d(tiles.keys(a), tiles.keys(b))), n


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)]
    want = merge({n for x in links for n in x}, links)
    got = {r.node: r.component_id for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] for x in links)}


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows: list[tuple[int | None, list | None]] = []
    for size, noise in ((40, 0.03), (30, 0.2), (25, 0.4), (1, 0)):
        centre = rng.standard_normal(24)
        rows += [(len(rows) + i, (centre + noise * rng.standard_normal(24)).tolist()) for i in range(size)]
    rows += [(len(rows) + i, rng.standard_normal(24).tolist()) for i in range(60)]
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(510, [x * 1e200 for x in rows[0][1]]), (511, (-np.array(rows[0][1])).tolist())]
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [math.nan] * 24), (604, [math.inf] + [1.0] * 23), (605, rows[0][1][:12])]
    rows += [(606, [None, *rows[0][1][1:]]), (607, rows[0][1][:12]), (None, rows[3][1])]
    unit = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a > b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp = merge([i for i, _ in rows if i is not None], links)
    want = {(i, sum(i in x for x in links), comp[i], comp[i] == i) for i, _ in rows if i is not None} | {(None, 0, None, False)}
    df = spark.createDataFrame([(i, v, 0, True) for i, v in rows], "vec_id bigint, embedding array<double>, n_links int, kept boolean")
    got = {tuple(r) for r in vectors.near_vectors(df).collect()}
    assert got == want
    assert any(0 < sum(i in x for x in links) < 24 for i in unit)  # some components are not complete
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_that_no_pass_brings_together(spark, monkeypatch):
    """One pass with one neighbour meets few of the links; those between rows of a crowded region are among them."""
    monkeypatch.setattr(vectors, "TILE", 24 * 50)
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    lone = unit(rng.standard_normal((150, 24)))
    centre = unit(rng.standard_normal(24))
    aside = rng.standard_normal((150, 24))
    hot = 0.9 * centre + math.sqrt(0.19) * unit(aside - (aside @ centre)[:, None] * centre)
    large = unit(unit(rng.standard_normal(24)) + 0.03 * rng.standard_normal((120, 24)))
    far = unit(np.concatenate([lone[:40], hot[:40]]) + 0.08 * rng.standard_normal((80, 24)))
    x = np.concatenate([lone, hot, large, far])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    comp = merge(range(len(x)), np.argwhere(np.triu(near)).tolist())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in vectors.near_vectors(df, count=1, window=1).collect()}
    assert got == {(i, int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}


def test_too_many_keys_for_a_filter_are_joined_instead(spark, monkeypatch):
    from quire.llm import base

    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(40)) for _ in range(30)]
    texts += [t + " more" for t in texts[:20]]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    run = lambda: sorted(map(tuple, jaccard.near_components(df, 3, 80).collect()))
    with_filter = run()
    monkeypatch.setattr(base, "FILTER_BITS", 1)
    assert run() == with_filter and len({c for _, _, c in with_filter}) == 30


def test_a_key_filter_passes_every_key_and_few_others(spark):
    from quire.llm import base

    keys = spark.range(0, 30_000, 3).withColumnRenamed("id", "node")
    known, bits = base.key_filter(keys, "node")
    places = np.array([r[0] for r in spark.range(30_000).select(base.filter_place("id", bits)).collect()])
    passed = base.may_be_among(places, known)
    assert passed[::3].all() and passed.mean() < 0.4
    none, bits = base.key_filter(keys.limit(0), "node")
    assert not any(none) and bits == 1 << 16
