"""Periodic runs against trying every period at every word."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quire.llm import periods


def brute(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, z - a, q) for (a, z), q in out.items() if z - a >= least), key=lambda r: (r[0], r[2]))


def texts(seed):
    rng = random.Random(seed)

    def block(k, size):
        return [rng.randrange(k) for _ in range(rng.randrange(1, size))]

    def repeated(root, most):
        return (root * most)[: rng.randrange(1, most)]

    for _ in range(60):
        k, n = rng.choice([1, 2, 2, 3, 4, 10, 1000]), rng.choice([5, 12, 30, 60, 150, 300])
        yield [rng.randrange(k) for _ in range(n)]
        yield sum((repeated(block(k, 12), 60) for _ in range(rng.randrange(1, 9))), [])
        # roots that are themselves highly periodic, so that no context tells their places apart
        root = repeated(block(k, 3), 60) * rng.randrange(1, 5)
        yield (root[: rng.randrange(1, len(root) + 1)] + [rng.randrange(k)]) * rng.randrange(1, 5)
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        yield b[rng.randrange(5) :]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("together", [1, 500, 150_000])
def test_every_run_and_no_other(seed, together, monkeypatch):
    monkeypatch.setattr(periods, "TOGETHER", together)
    words = [[str(x).encode() for x in t] for t in texts(seed)]
    for least in (2, 12):
        for w, got in zip(words, periods.runs_of_texts(words, least)):
            assert got == brute(w, least), w


def test_long_texts_with_long_periods():
    rng = random.Random(5)
    root = [b"%d" % rng.randrange(50) for _ in range(3000)]
    text = root * 7 + [b"x"] * 4000 + root[:10] * 300
    got = periods.runs_of_texts([text], 12)[0]
    assert (0, 21000, 3000) in got and (21000, 4000, 1) in got and any(q == 10 and n >= 3000 for _, n, q in got)
    assert (0, 1_000_000, 2) in periods.runs_of_texts([[b"a", b"b"] * 500_000], 12)[0]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def want(doc_id, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    one = [*top, 1000 * top[1] // top[2]] if top else [None] * 4

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *one, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def test_the_query_over_all_kinds_of_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab cd ef") for _ in range(rng.randrange(80)))) for i in range(150)]
    rows += [(200 + i, "one two three " * rng.randrange(30) + f"end{i}") for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r "), (None, "a b " * 20), (None, None), (5, rows[5][1]), (6, "other text " * 9)]
    rows += [(303, "x\x1cy\x85z\xa0w　v " * 20), (304, "ä\tö\nü\x0bß\x0cé\rñ " * 20), (305, "w" * 200_000), (306, "p q " * 60_000)]
    df = spark.createDataFrame([(i, t, 1, "r", "w") for i, t in rows], "doc_id bigint, text string, n_words int, runs string, _w string")
    got = sorted(map(tuple, periods.digests(df).collect()), key=str)
    big = {306}
    assert [g for g in got if g[0] not in big] == sorted((want(*r) for r in rows if r[0] not in big), key=str)
    assert [g[1:5] for g in got if g[0] == 306] == [(1, 0, 120_000, 2)] or zlib.crc32(b"306") % 10 == 0
    assert periods.digests(df.limit(0)).count() == 0


def test_the_operator_gives_runs_and_text(spark):
    df = spark.createDataFrame([(1, "a b c " * 5 + "d")], "doc_id int, text string")
    row = periods.periodic_runs(df).first()
    assert row.n_words == 16 and [tuple(r) for r in row.runs] == [(0, 15, 3)] and bytes(row.collapsed) == b"a b c d"
    assert periods.periodic_runs(df, least=16).first().runs == []
