"""Line deduplication against counting lines, and the runs themselves."""

from __future__ import annotations

from collections import defaultdict

from quire.llm import lines

SCHEMA = "doc_id bigint, text string, kept string, gone string, _gone string, _kept string, _row string, _text int, h1 int, _n_lines int"
LONG, OTHER = "a line that is well over forty characters long, is it not", "Another Line of more than forty characters, in mixed case"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "a", "b", "c", 1, 2, 3) for i, t in rows], SCHEMA)


def rows():
    out = [(i, f"own {i}\n  {LONG}\t\n{OTHER if i % 2 else OTHER.upper()}\n{LONG}") for i in range(9)]
    out += [(20, "short line"), (21, None), (22, ""), (23, "\n\n"), (None, f"{LONG}\nkeep"), (3, f"{LONG}\nagain"), (24, LONG + "　")]
    out += [(30 + i, "four documents hold this line of over forty characters\nx") for i in range(4)]
    return [*out, (5, out[5][1]), (40, "\n".join([LONG] * 500 + ["end"]))]


def brute(data, least=40, documents=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in data:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    common = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, t in data:
        have = (t or "").split("\n")
        kept = [x for x in have if not (key(x) in common and common[key(x)] != i)]
        out.append((i, "\n".join(kept), len(have), len(have) - len(kept)))
    return sorted(out, key=str)


def test_against_counting(spark):
    got = lines.drop_repeated_lines(table(spark, rows())).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())
    assert lines.digests(table(spark, [])).count() == 0


def test_other_columns_stay(spark):
    df = table(spark, rows())
    got = lines.replaced(df)
    assert got.columns == df.columns and got.where("kept != 'x' OR gone != 'y'").count() == 0
    assert got.where("doc_id = 21 AND text IS NULL").count() == 1


def test_runs_are_levelled_and_know_what_is_new(spark):
    store = lines.LineRuns(spark, fanout=2, buckets=4)
    seen: dict = {}
    for batch in range(5):
        docs = [(10 * batch + d, k, k) for d in range(3) for k in range(batch, batch + 4)]
        store.add(spark.createDataFrame(docs, "doc_id bigint, h1 bigint, h2 bigint"))
        for d, k, _ in docs:
            seen.setdefault(k, set()).add(d)
        # a level never holds as many runs as the fan-out
        assert all(len(level) < 2 for level in store.levels)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    got = {r.h1: (r.n_docs, r.top_doc) for r in store.totals().collect()}
    assert got == {k: (len(v), max(v)) for k, v in seen.items()}
    newest = spark.table(store.levels[0][0])
    assert {r.h1 for r in newest.where("fresh").collect()} == {7}


def test_no_python_on_the_way(spark):
    plan = lines.digests(table(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_meet_their_dropped_lines_by_a_merge_at_every_size(spark):
    """No list of lines is broadcast while it is small, so the plan, and what it shuffles, grows evenly."""
    docs = spark.createDataFrame([(i, f"own {i}\n" + "x" * 50) for i in range(6)], "doc_id bigint, text string")
    done = lines.drop_repeated_lines(docs)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan
    assert {r.doc_id: r.n_dropped for r in done.collect()} == {i: int(i < 5) for i in range(6)}
