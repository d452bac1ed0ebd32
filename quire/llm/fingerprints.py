"""Document fingerprints by order MinHash.

The k-mers of a text are numbered by occurrence, so a repeated one counts as often as it stands
there. For each of ``functions`` random orders the least ``tuple_size`` of them are selected, put back
into the order they have in the text, and their k-mers hashed as one tuple. The share of equal hashes
in two fingerprints falls with the edit distance: with letters that are gone, and also with letters
that changed places.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import lasting, partitions
from quire.session import forgotten

#: Ranges of ids for each task, so that tasks differ little in size, and rows that a key has at least
#: before it counts as frequent.
RANGES, MANY = 8, 1000

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass(frozen=True)
class Order:
    """What a fingerprint is made of: k-mers of ``k`` code points, ``tuple_size`` of them for each of ``functions``."""

    k: int = 12
    tuple_size: int = 2
    functions: int = 64
    seed: int = 1

    def factors(self) -> np.ndarray:
        """An odd 32-bit factor for each function; the order of the products is its random order."""
        seeds = np.arange(1, self.functions + 1, dtype=np.uint64) + _U(self.seed * 0x9E3779B97F4A7C15 % 2**64)
        return (mixed(seeds) >> _U(32)).astype(np.uint32) | np.uint32(1)


def kmers(text: str, k: int) -> np.ndarray:
    """A hash of the ``k`` code points at every place; a shorter text is one k-mer, an empty one none."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    k = min(k, len(letters))
    h, reach, factor = letters + _U(k), 1, 0x9FB21C651E98DF25
    while reach < k:  # parts twice as long each time; the last two overlap and cover the k letters
        step = min(reach, k - reach)
        h, reach = h[:-step] * _U(factor) + h[step:], reach + step
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    return mixed(h)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(h)
    ordered = h[order]
    again = ordered[1:] == ordered[:-1]
    out = np.zeros(len(h), np.uint64)
    if again.any():
        inside = np.zeros(len(h), bool)
        inside[1:] |= again
        inside[:-1] |= again
        places = order[inside]
        places = places[np.lexsort((places, h[places]))]
        first = np.diff(h[places], prepend=~h[places[:1]]) != 0
        begin = np.flatnonzero(first)
        out[places] = (np.arange(len(places)) - np.repeat(begin, np.diff(np.append(begin, len(places))))).astype(np.uint64)
    return out


def signature(text: str, rule: Order, factors: np.ndarray) -> np.ndarray:
    """One 32-bit hash for each function. An empty text has the hash of an empty tuple everywhere."""
    h = kmers(text, rule.k)
    n = len(h)
    out = np.full(rule.functions, rule.k, np.uint64)
    size = min(rule.tuple_size, n)
    if size:
        numbered = (mixed(h + occurrences(h) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32)
        block = max(1, 65536 // n)
        for at in range(0, rule.functions, block):
            ranks = numbered * factors[at : at + block, None]
            row = np.arange(len(ranks))
            chosen = np.empty((len(ranks), size), np.int64)
            for j in range(size):
                chosen[:, j] = best = ranks.argmin(axis=1)
                ranks[row, best] = 0xFFFFFFFF
            chosen.sort(axis=1)
            for j in range(size):
                out[at : at + block] = mixed(out[at : at + block] * _U(0x9FB21C651E98DF25) + h[chosen[:, j]])
    return (out >> _U(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the functions whose tuples agree, from 0 to 1."""
    return float(np.mean(a == b))


def fingerprints(docs: DataFrame, rule: Order = Order(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint): 8 hexadecimal digits for each function, over every whole text.

    No shuffle: a text is worked out where it is read. Equal texts have equal fingerprints; a null
    text counts as empty, and empty texts share a fingerprint; a text under ``k`` code points is one
    k-mer. Equal rows give equal rows; a null id stays null; an empty table gives no rows; other
    columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = rule.factors()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [signature(t, rule, factors).tobytes().hex() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())],
                names=[id_col, "n_chars", "fingerprint"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, n_chars bigint, fingerprint string")


def likeness_column(a: str, b: str, rule: Order = Order()) -> F.Column:
    """The likeness of two fingerprint columns, for joins of candidates; null where one is null."""
    digits = [F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8) for i in range(rule.functions)]
    return sum((d.cast("int") for d in digits), F.lit(0)) / F.lit(float(rule.functions))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): what documents are ordered by, descending by id, those without an id last; of
    equal ids the smaller text hash comes first. Rows equal in both are equal texts of one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def sort_key(doc_id: int | None, h: int) -> tuple:
    return (doc_id is None, -(doc_id or 0), h)


def range_starts(rows: DataFrame, ranges: int) -> tuple[list[tuple], dict[tuple, int]]:
    """The first key of each of about ``ranges`` ranges of equal size, in order, and the keys of more rows
    than such a range with their counts. Only keys are shuffled, counted before; what comes to the driver
    is one key for each range and as many frequent ones at most."""
    counts = lasting(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")), "key_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") > max(MANY, total // ranges)).collect()
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = counts.select("doc_id", "h").repartitionByRange(ranges, *order)
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), (-F.col("doc_id")).alias("down"), "h"))
    found = dealt.groupBy(F.spark_partition_id().alias("part")).agg(first.alias("f")).collect()
    forgotten(counts)
    return sorted((r.f.none, r.f.down or 0, r.f.h) for r in found), {sort_key(r.doc_id, r.h): r.n for r in often}


def in_ranges(rows: DataFrame, starts: list[tuple], often: dict[tuple, int]) -> DataFrame:
    """Documents by range, sorted, each range followed by the first document of the next (``tail``), the
    last one by the very first: so every document has its successor beside it. Each text is shuffled
    once, of a frequent one a copy for each task; a range is read as a stream."""
    n = partitions(rows.sparkSession)
    before = {key: (i - 1) % len(starts) for i, key in enumerate(starts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keys = [sort_key(*k) for k in zip(*(batch.column(c).to_pylist() for c in range(2)))]
            main = []
            for i, key in enumerate(keys):
                if key in often:
                    if key in seen:
                        continue
                    seen.add(key)
                main.append(i)
            extra = [i for i in main if keys[i] in before]
            part = [bisect.bisect_right(starts, keys[i]) - 1 for i in main] + [before[keys[i]] for i in extra]
            tail = pa.array([False] * len(main) + [True] * len(extra), pa.bool_())
            taken = batch.take(pa.array([*main, *extra], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), tail, *taken.columns], names=["part", "tail", *batch.schema.names])

    dealt = rows.mapInArrow(deal, "part int, tail boolean, doc_id bigint, h bigint, text string")
    order = ["part", "tail", F.col("doc_id").desc_nulls_last(), "h", "text"]
    return dealt.repartition(n, "part").sortWithinPartitions(*order)


def beside_next(docs: DataFrame, each: Callable, names: list[str], kinds: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, *names) for every document: what the function that ``each()`` gives makes of its text
    and the next one's.

    The next document is that of the next smaller id, after the last the first. Rows without an id come
    last; rows of one id are ordered by a hash of their text, so a row that is there several times is
    its own next but for the last of them. A single row is its own next. Results of a text that more
    rows share than a range holds are worked out once and repeated.
    """
    rows = keyed(docs, id_col, text_col)
    starts, often = range_starts(rows, RANGES * partitions(docs.sparkSession))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, held = each(), None
        for batch in batches:
            done: list[tuple] = []
            for part, tail, doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                key = sort_key(doc_id, h)
                if held is not None and held[0] == part:
                    if key in often and key == held[1] and not tail:
                        continue  # the copy of another task
                    if held[1] in often:
                        done.append((held[2], often[held[1]] - 1, *fn(held[3], held[3])))
                    done.append((held[2], 1, *fn(held[3], text)))
                held = None if tail else (part, key, doc_id, text)
            columns = [*zip(*done)] if done else [()] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names=["doc_id", "_rows", *names])

    known = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    arrow = [pa.int64(), pa.int64(), *(known[k] for k in kinds.split())]
    shape = ", ".join(["doc_id bigint, _rows bigint", *(f"{n} {k}" for n, k in zip(names, kinds.split()))])
    out = in_ranges(rows, starts, often).mapInArrow(work, shape)
    if not often:
        return out.drop("_rows")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_rows"))).drop("_rows", "_copy")


def edited_end(text: str, following: str) -> str:
    """``text`` with the last third of its code points replaced by as many first ones of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def edits(docs: DataFrame, rule: Order = Order(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): how a
    fingerprint withstands an edit of the last third, and how like the next document it is.

    ``edited`` is UTF-8. Nulls, empty texts, repeated rows and missing ids as in :func:`fingerprints`
    and :func:`beside_next`; an id that is no whole number counts as missing.
    """

    def each() -> Callable:
        factors, last = rule.factors(), ["", None]

        def own(text: str) -> np.ndarray:
            if last[1] is None or last[0] != text:  # the next document is the following one's own
                last[:] = text, signature(text, rule, factors)
            return last[1]

        def one(text: str, following: str) -> tuple:
            changed = edited_end(text, following)
            mine = own(text)
            other = signature(changed, rule, factors) if changed != text else mine
            near_next = likeness(mine, own(following))
            return (
                len(text), changed.encode("utf-8"), mine.tobytes().hex(), other.tobytes().hex(), likeness(mine, other), near_next
            )

        return one

    names = ["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return beside_next(docs, each, names, "bigint binary string string double double", id_col, text_col)


def digests(docs: DataFrame) -> DataFrame:
    return edits(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
