"""Repeated windows of words and of bytes against counting every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from quire.llm import substrings, suffixes

SCHEMA = "doc_id bigint, text string, kept string, at string"


def texts() -> list:
    """Shared passages in many texts, copies, periodic text, short, null, empty and long ones."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    out = [f"{prose(rng.randint(0, 40))} {passage} {prose(rng.randint(0, 40))}" for _ in range(25)]
    out += [prose(60)] * 3 + ["la " * 200, "xy" * 400, "", None, " \t\n", "one", prose(4000), passage[:250], "z" * 199, "z" * 200]
    half = prose(45)
    return out + [half + "\n" + half, half.replace(" ", " \x0b\n"), out[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def want_words(rows, k=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[j : j + k]) for _, w in words for j in range(len(w) - k + 1))
    return [(i, *cut(w, [j for j in range(len(w) - k + 1) if count[tuple(w[j : j + k])] > 1], k, b" ".join)) for i, w in words]


def want_bytes(rows, k=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(x[j : j + k] for _, x in raw for j in range(len(x) - k + 1))
    return [(i, *cut(x, [j for j in range(len(x) - k + 1) if count[x[j : j + k]] > 1], k, bytes)) for i, x in raw]


def cut(units, starts, k, join):
    gone = [False] * len(units)
    for j in starts:
        gone[j : j + k] = [True] * k
    runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
    return len(units), sum(gone), runs, hashlib.sha256(join([u for u, g in zip(units, gone) if not g])).hexdigest()


@pytest.mark.parametrize("small", [substrings.SMALL, 3], ids=["whole", "split"])
def test_words(spark, small):
    rows = [*enumerate(texts()), (None, texts()[0]), (3, texts()[40])]
    got = substrings.drop_repeated_windows(frame(spark, rows), small=small).collect()
    found = [(r.doc_id, r.n_units, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=str) == sorted(want_words(rows), key=str)


@pytest.mark.parametrize("small", [suffixes.SMALL, 3], ids=["whole", "split"])
def test_bytes(spark, small):
    rows = [*enumerate(texts()), (None, texts()[0]), (3, texts()[40])]
    got = suffixes.drop_repeated_strings(frame(spark, rows), small=small).collect()
    found = [(r.doc_id, r.n_units, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=str) == sorted(want_bytes(rows), key=str)


def test_nothing(spark):
    for run in (substrings.digests, suffixes.digests):
        assert run(frame(spark, [])).count() == 0
        assert [r.n_removed for r in run(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_cover_holds_every_difference():
    cover = suffixes.COVER
    assert {int((a - b) % suffixes.PERIOD) for a in cover for b in cover} == {*range(suffixes.PERIOD)}
    assert len(cover) < 10


def test_rows_without_an_id_keep_their_own_repeats(spark):
    """Many rows without an id, one of them repeated: only it and its copy are cut."""
    from pyspark.sql import functions as F

    from quire.llm import substrings, superstrings

    n = 300_000
    plain = spark.range(n).select(F.lit(None).cast("string").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"))
    keys = superstrings.keyed(plain, "doc_id", "text")
    assert keys.select("k1", "k2").distinct().count() == n
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"own {i} text") for i in range(50)] + [(None, long), (None, long), ("a", "other words"), ("b", long + " and more")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = substrings.drop_repeated_windows(df).collect()
    assert sorted(r.n_removed for r in got if r.n_removed) == [60, 60, 60]
    assert all(bytes(r.kept).decode() == t for r, t in zip(sorted((r for r in got if not r.n_removed), key=lambda r: bytes(r.kept)), sorted(t for _, t in rows if not t.startswith("w0"))))
