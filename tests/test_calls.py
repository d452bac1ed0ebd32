"""Model calls: the pool, back-off, and the log that keeps a call from being made twice."""

from __future__ import annotations

import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import calls

NONE = calls.Retry(attempts=1)


def counting(folder):
    """A model that leaves a file for every call it gets."""

    def model(prompt):
        name = f"{prompt.replace(' ', '_')}-{time.monotonic_ns()}-{threading.get_ident()}"
        (Path(folder) / name).write_text("")
        return prompt.upper()

    return model


def asked(folder):
    return sorted(p.name.split("-")[0] for p in Path(folder).iterdir())


def test_every_prompt_is_asked_once_and_a_second_run_asks_nothing(spark, tmp_path):
    seen, log = tmp_path / "seen", str(tmp_path / "log")
    seen.mkdir()
    prompts = spark.range(300).select("id", F.when(F.col("id") < 200, "hot").when(F.col("id") < 299, F.concat(F.lit("p"), "id")).alias("prompt"))
    first = {r.id: (r.reply, r.call_error) for r in calls.infer_logged(prompts, counting(seen), log, buckets=4).collect()}
    assert len(first) == 300 and first[0] == ("HOT", None) and first[250] == ("P250", None) and first[299] == (None, None)
    assert asked(seen) == sorted(["hot", *(f"p{i}" for i in range(200, 299))])
    again = calls.infer_logged(prompts.union(spark.createDataFrame([(999, "fresh")], prompts.schema)), counting(seen), log, buckets=4)
    rows = {r.id: (r.reply, r.calls) for r in again.collect()}
    assert rows[0] == ("HOT", 0) and rows[999] == ("FRESH", 1) and len(asked(seen)) == 101
    # a bucket's log is one file once it is done
    assert all(len([*b.glob("*.jsonl")]) == 1 for b in Path(log).iterdir())


def test_a_task_killed_halfway_asks_nothing_again(spark, tmp_path):
    seen, log, flag = tmp_path / "seen", str(tmp_path / "log"), tmp_path / "killed"
    seen.mkdir()
    tell, mark = counting(seen), str(flag)

    def dying(prompt):
        import os

        if prompt == "p37" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)  # the worker is gone, as with a lost executor
        return tell(prompt)

    prompts = spark.range(60).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    with pytest.raises(Exception):
        calls.infer_logged(prompts, dying, log, buckets=1, pool=1).collect()
    before = asked(seen)
    assert 0 < len(before) < 60
    got = calls.infer_logged(prompts, dying, log, buckets=1, pool=1).collect()
    assert {r.reply for r in got} == {f"P{i}" for i in range(60)}
    assert asked(seen) == sorted(f"p{i}" for i in range(60))  # none of them twice


def test_back_off_and_errors_that_are_not_tried_again():
    waits, tries = [], []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise TimeoutError("slow")
        return "done"

    sleep, calls.time.sleep = calls.time.sleep, waits.append
    try:
        assert calls.Retry().ask(flaky, "x") == ("done", None, 3)
        assert waits == [1.5, 3.0]
        assert calls.Retry().ask(lambda p: 1 / 0, "x") == (None, "division by zero", 1)
        waits.clear()

        def never(prompt):
            raise ConnectionError("down")

        assert calls.Retry().ask(never, "x") == (None, "down", 4) and waits == [1.5, 3.0, 6.0]
    finally:
        calls.time.sleep = sleep


def test_errors_are_rows_and_are_asked_again(spark, tmp_path):
    ready = str(tmp_path / "ready")

    def model(prompt):
        import os

        if prompt == "bad" and not os.path.exists(ready):
            raise ValueError("no answer")
        return prompt.upper()

    prompts = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    run = lambda: {r.id: (r.reply, r.call_error, r.calls) for r in calls.infer_logged(prompts, model, str(tmp_path / "log"), buckets=2).collect()}
    assert run() == {1: ("GOOD", None, 1), 2: (None, "no answer", 1)}
    open(ready, "w").close()
    assert run() == {1: ("GOOD", None, 0), 2: ("BAD", None, 1)}


def test_the_pool_is_bounded_and_used(spark, tmp_path):
    def slow(prompt):
        import threading as t
        import time as c

        n = t.active_count()
        c.sleep(0.05)
        return str(n)

    prompts = spark.range(40).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    began = time.monotonic()
    rows = calls.infer_logged(prompts, slow, str(tmp_path / "log"), buckets=1, pool=8, retry=NONE).collect()
    assert len(rows) == 40 and max(int(r.reply) for r in rows) >= 8
    assert time.monotonic() - began < 30


def test_replies_that_come_together_share_a_file(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    class Slow(calls.Log):
        def add(self, replies):
            time.sleep(0.02)
            return super().add(replies)

    log, known, files = Slow(str(tmp_path), 0), {}, []

    def noted(i):
        log.noted(f"p{i}", f"r{i}", known, files)
        assert f"p{i}" in known  # it is in the log before the next call is made

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(noted, range(80)))
    assert log.known()[0] == known == {f"p{i}": f"r{i}" for i in range(80)} and len(files) < 60
