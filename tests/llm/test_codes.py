"""Vector codes against full rounds over every entry."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, entry string, near int"


def brute(rows, rounds=codes.ROUNDS):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(Fraction(x) * 4096) for x in v] for _, v, _ in kept]
    width = len(whole[0]) if whole else 0
    edge = [width * p // 8 for p in range(9)]
    parts = [[w[a:z] for w in whole] for a, z in zip(edge, edge[1:])]
    books = [[*own[:16]] for own in parts]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(zip(d, range(len(book))))

    for _ in range(rounds):
        for p, own in enumerate(parts):
            at = [nearest(x, books[p])[1] for x in own]
            for e in range(len(books[p])):
                mine = [x for x, a in zip(own, at) if a == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    done = []
    for k, (i, _, y) in enumerate(kept):
        near = [nearest(parts[p][k], books[p]) for p in range(8)]
        done.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), y))
    sums = {}
    for _, _, error, y in done:
        sums[y] = sums.get(y, 0) + error
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, min(e, codes.LARGEST), min(sums[y], codes.LARGEST), sha) for i, c, e, y in done), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], SCHEMA)
    return sorted(map(tuple, codes.digests(df).collect()), key=str)


def test_against_full_rounds(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.choice([0, 1, None])) for i in range(300)]
    rows += [(400 + i, rows[3][1], 5) for i in range(150)]  # copies
    rows += [(600, None, 1), (601, [float("nan")] * 16, 1), (602, [None, *[0.0] * 15], 1), (603, [float("inf"), *[0.0] * 15], 1)]
    rows += [(604, [0.0] * 16, None), (605, [-0.0] * 16, None), (None, [0.5] * 16, 2), (7, [0.25] * 16, 2), (7, [0.25] * 16, 2), (606, [1.0] * 3, 2)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("width", [1, 8, 11])
def test_few_vectors_ties_and_odd_widths(spark, width):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-1, 0, 1]) / 4096 for _ in range(width)], i % 2) for i in range(40)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:3]) == brute(rows[:3])


def test_numbers_of_any_size(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e300, -1.7e308, 1e-300, -1e-300, 3e9, 0.1]) for _ in range(8)], 1) for i in range(40)]
    rows += [(100 + i, [rng.gauss(0, 1) for _ in range(8)], 2) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []


def test_a_missing_label_column_and_empty_vectors(spark):
    df = spark.createDataFrame([(1, []), (2, [])], "vec_id int, embedding array<float>")
    done, books = codes.encode(df, label_col=None)
    assert {(r.vec_id, r.code, r.error) for r in done.collect()} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}


def test_only_moved_entries_are_looked_at(monkeypatch):
    rng = np.random.default_rng(3)
    x, book = rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (16, 4))
    d = codes.distances(x, book)
    entry, distance = d.argmin(axis=1), d.min(axis=1)
    new = book.copy()
    new[[2, 9]] += rng.integers(-20, 20, (2, 4))
    new[5] = new[4]  # a tie that the lower index wins
    moved = (new != book).any(axis=1)
    asked, plain = [], codes.distances
    monkeypatch.setattr(codes, "distances", lambda a, b: asked.append((len(a), len(b))) or plain(a, b))
    got_e, got_d = codes.active_assignment(x, new, moved, entry, distance)
    full = plain(x, new)
    assert (got_e == full.argmin(axis=1)).all() and (got_d == full.min(axis=1)).all()
    lost = int(moved[entry].sum())
    assert asked == [(lost, 16), (400 - lost, int(moved.sum()))] and 0 < lost < 400
