"""Order MinHash against its definition, and the edited texts against the table in order."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quire.llm import fingerprints as fp

RULE = fp.Order(k=4, tuple_size=3, functions=16)


def by_definition(text, rule):
    """Tuples of the selected k-mers as texts, one for each function, by sorting all of them."""
    k = min(rule.k, len(text))
    seen, numbered = Counter(), []
    for i in range(len(text) - k + 1 if k else 0):
        mer = text[i : i + k]
        numbered.append((mer, seen[mer], i))
        seen[mer] += 1
    h = fp.kmers(text, rule.k)
    value = (fp.mixed(h + np.array([n for _, n, _ in numbered], np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out = []
    for f in rule.factors():
        best = sorted(range(len(numbered)), key=lambda i: (int(value[i]) * int(f) % 2**32, i))[: rule.tuple_size]
        out.append(tuple(numbered[i][0] for i in sorted(best)))
    return out


def sample(rng, n, letters="abcd äß汉🙂"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_equal_tuples_and_only_those_give_equal_hashes():
    rng = random.Random(1)
    texts = ["", "a", "ab", "abc", "abcd", "aaaaaaaaaaaa", *(sample(rng, rng.randrange(2, 90)) for _ in range(60))]
    texts += [t[: len(t) // 2] + sample(rng, 5) + t[len(t) // 2 :] for t in texts] + [t[::-1] for t in texts]
    factors = RULE.factors()
    signs = [fp.signature(t, RULE, factors) for t in texts]
    tuples = [by_definition(t, RULE) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            same = [x == y for x, y in zip(tuples[a], tuples[b])]
            assert (signs[a] == signs[b]).tolist() == same, (texts[a], texts[b])


def test_occurrences_and_large_texts():
    h = np.array([5, 7, 5, 5, 9, 7], np.uint64)
    assert fp.occurrences(h).tolist() == [0, 0, 1, 2, 0, 1]
    text = sample(random.Random(2), 300_000)
    factors = fp.Order().factors()
    one = fp.signature(text, fp.Order(), factors)
    assert fp.likeness(one, fp.signature(text, fp.Order(), factors)) == 1.0
    assert fp.likeness(one, fp.signature(text[:-100], fp.Order(), factors)) > 0.9
    # the same parts in another order: most k-mers are shared, yet the order shows
    turned = fp.likeness(one, fp.signature(text[150_000:] + text[:150_000], fp.Order(), factors))
    assert 0.3 < turned < 0.7


def test_likeness_falls_with_edits():
    rng = random.Random(4)
    means = []
    for changes in (0, 5, 20, 80):
        near = []
        for _ in range(30):
            text = sample(rng, 600, "abcdefghijklmnopqrstuvwxyz")
            letters = [*text]
            for _ in range(changes):
                letters[rng.randrange(600)] = "#"
            rule = fp.Order()
            near.append(fp.likeness(fp.signature(text, rule, rule.factors()), fp.signature("".join(letters), rule, rule.factors())))
        means.append(sum(near) / 30)
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3]


def rows():
    rng = random.Random(7)
    out = [(i, sample(rng, rng.randrange(60))) for i in range(200)]
    out += [(500, None), (501, ""), (502, "x" * 50_000), (-3, "negative id"), (7, "same id, other text"), (9, out[9][1]), (9, out[9][1])]
    return [*out, (None, "no id"), (None, "no id either"), (None, "no id"), *[(600, "hot row")] * 100]


def want(data, hashes):
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""]))
    factors, rule = fp.Order().factors(), fp.Order()
    out = []
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]]):
        t, following = t or "", following or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        a, b, c = (fp.signature(x, rule, factors) for x in (t, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), sha, a.tobytes().hex(), b.tobytes().hex(), fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts, many", [(1, 1000), (5, 1000), (8, 2), (8, 1)])
def test_the_query_over_all_kinds_of_rows(spark, parts, many, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fp, "MANY", many)
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "tail", 2) for i, t in data], "doc_id bigint, text string, h int, tail string, part int")
    hashes = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    got = fp.digests(df.repartition(parts).checkpoint()).collect()
    assert sorted(map(tuple, got), key=str) == want(data, hashes)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    row = fp.edits(df).first()
    assert bytes(row.edited) == b"abcdab" and row.near_next == 1.0
    assert fp.digests(df.limit(0)).count() == 0


def test_fingerprints_can_be_joined(spark):
    text = sample(random.Random(8), 400)
    df = spark.createDataFrame([(1, text), (2, text), (3, text[:300] + "Z" * 100), (4, None)], "doc_id bigint, text string")
    own = fp.fingerprints(df)
    pairs = own.alias("a").crossJoin(own.withColumnRenamed("fingerprint", "other").withColumnRenamed("doc_id", "b"))
    near = {(r.doc_id, r.b): r.near for r in pairs.withColumn("near", fp.likeness_column("fingerprint", "other")).collect()}
    assert near[1, 2] == 1.0 and 0.1 < near[1, 3] < 1 and near[1, 4] == 0.0
