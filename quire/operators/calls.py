"""Model calls at scale: a bounded pool of calls in each task, back-off, and a log of replies, so that
nothing that was answered is ever asked, or paid for, again."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from queue import SimpleQueue
from threading import Lock

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import session
from quire.operators.memory import ModelCall
from quire.sources.files import opened

REPLIES = "prompt_id string, reply string, call_error string, calls int"


@dataclass(frozen=True)
class Retry:
    """How often a call is made and how long is waited after each failure: ``first`` seconds, then twice as
    long each time. Errors of other kinds than ``on`` are not tried again."""

    attempts: int = 4
    first: float = 1.5
    on: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError, json.JSONDecodeError, KeyError, IndexError)

    def ask(self, complete: ModelCall, prompt: str) -> tuple[str | None, str | None, int]:
        """(reply, error, calls made)."""
        for n in range(1, self.attempts + 1):
            try:
                return complete(prompt), None, n
            except Exception as bad:  # one failed call must not fail the job
                if n == self.attempts or not isinstance(bad, self.on):
                    return None, str(bad), n
                time.sleep(self.first * 2 ** (n - 1))
        return None, "no attempt", 0


class Log:
    """Replies of one bucket of prompts, as small files in a folder of its own. A reply is there for every
    later reader once its file is closed."""

    def __init__(self, root: str, bucket: int):
        self.store, base = opened(root)
        self.folder = f"{base}/bucket={bucket}"
        self.store.create_dir(self.folder, recursive=True)
        self.waiting, self.writing = SimpleQueue(), Lock()

    def known(self) -> tuple[dict[str, str], list[str]]:
        """Replies by prompt, and the files they are in."""
        out: dict[str, str] = {}
        files = [f.path for f in self.store.get_file_info(fs.FileSelector(self.folder)) if f.path.endswith(".jsonl")]
        for path in sorted(files):
            with self.store.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    row = json.loads(line)
                    out[row["id"]] = row["reply"]
        return out, files

    def add(self, replies: dict[str, str]) -> str:
        draft, final = f"{self.folder}/.{uuid.uuid4().hex}", f"{self.folder}/{uuid.uuid4().hex}.jsonl"
        with self.store.open_output_stream(draft) as f:
            f.write("".join(json.dumps({"id": k, "reply": v}) + "\n" for k, v in replies.items()).encode())
        self.store.move(draft, final)
        return final

    def noted(self, key: str, reply: str, known: dict[str, str], files: list[str]) -> None:
        """Log a reply, back once it is there. Replies that come while a file is written share the next one."""
        self.waiting.put((key, reply))
        with self.writing:
            if key not in known:
                fresh = dict(self.waiting.get() for _ in range(self.waiting.qsize()))
                files.append(self.add(fresh))
                known.update(fresh)

    def compacted(self, replies: dict[str, str], files: list[str]) -> None:
        """One file in place of many; what is in both for a moment is read the same twice."""
        if len(files) > 1:
            self.add(replies)
            for path in files:
                self.store.delete_file(path)


def infer_logged(
    prompts: DataFrame, complete: ModelCall, log: str, *, pool: int = 8, buckets: int | None = None, retry: Retry = Retry()
) -> DataFrame:
    """``prompts`` with ``reply``, ``call_error`` and ``calls``: every distinct prompt is asked once.

    Prompts are dealt into buckets by their hash, the same ones in every run. A task asks ``pool`` of them
    at a time and logs each reply under ``log``, a folder all executors share, as soon as it is there; those
    that come while a file is written share the next. A
    task that is run again, and a later run over the same or other prompts, reads the log first and asks
    only what has no reply; ``calls`` is then 0. Errors are not logged, so they are asked again next time.
    Equal prompts, a third of all rows perhaps, are one call; a null prompt has no reply and no error.
    """
    spark = prompts.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = prompts.withColumn("prompt_id", F.sha2("prompt", 256))
    once = keyed.where("prompt IS NOT NULL").groupBy("prompt_id").agg(F.any_value("prompt").alias("prompt"))
    dealt = once.withColumn("bucket", F.pmod(F.xxhash64("prompt_id"), F.lit(n)).cast("int"))
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: Log | None = None
        now, known, files = None, {}, []
        with ThreadPoolExecutor(pool) as workers:
            for batch in batches:
                for bucket, rows in batch.groupby("bucket", sort=False):
                    if bucket != now:
                        if kept is not None:
                            kept.compacted(known, files)
                        now, kept = bucket, Log(log, bucket)
                        known, files = kept.known()

                    def one(row: tuple[str, str]) -> tuple:
                        key, prompt = row
                        if key in known:
                            return key, known[key], None, 0
                        reply, error, calls = retry.ask(complete, prompt)
                        if error is None:
                            kept.noted(key, reply, known, files)
                        return key, reply, error, calls

                    done = list(workers.map(one, zip(rows["prompt_id"], rows["prompt"])))
                    yield pd.DataFrame(done, columns=["prompt_id", "reply", "call_error", "calls"])
            if kept is not None:
                kept.compacted(known, files)

    replies = session.written(dealt.select("bucket", "prompt_id", "prompt").mapInPandas(ask, REPLIES), "logged_replies")
    return keyed.join(replies, "prompt_id", "left").drop("prompt_id", "prompt")
