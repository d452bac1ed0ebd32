"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding undoes look-alike letters and digits put for letters. The lexicon holds words and beginnings
of words; the longest entry that fits a word decides its weight, and exceptions are longer entries
(whole words, or a word with the next) of weight 0. The weights of a text, set against its length,
give a probability.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import remainder

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled rows that the lexicon and the probability are fitted on, and entries of the lexicon.
SAMPLE_ROWS = 20_000
TERMS = 4_000

# Letters of other scripts that look like Latin ones, and digits that stand for letters.
LOOKALIKES = dict(zip("аеорсхуіјѕкмтвнԁɡοαειкνρτυχ", "aeopcxyijskmtbhdgoaeiknptux", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
FOLD = str.maketrans(LOOKALIKES | DIGITS | dict.fromkeys(map(chr, [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]), None))
WORD = re.compile(r"\w+")
MONEY = re.compile(r"\$(?=\w)")
START, END = 3, 8


def fold(text: str | None) -> str:
    """Words of the text in folded letters, each with a space before, and one at the end."""
    text = unicodedata.normalize("NFKC", text or "").lower().translate(FOLD)
    if "$" in text:
        text = MONEY.sub("s", text)
    words = WORD.findall(text)
    return f" {' '.join(words)} " if words else ""


def entries(folded: str) -> set[str]:
    """What a lexicon may hold of a text: its words, their beginnings, and pairs of neighbours."""
    words = folded.split()
    out = {f" {w[:k]}" for w in set(words) for k in range(START, min(END, len(w) - 1) + 1)}
    out.update(f" {w} " for w in words)
    out.update(f" {a} {b} " for a, b in zip(words, words[1:]))
    return out


@functools.lru_cache(maxsize=2)
def automaton(lexicon: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for entry, weight in lexicon:
        found.add_word(entry, (len(entry), weight))
    if lexicon:
        found.make_automaton()
    return found


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights (0: an exception), and the coefficients of the probability."""

    weights: tuple[tuple[str, float], ...]
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, distinct words that have one, and words in all."""
        folded = fold(text)
        n = max(0, folded.count(" ") - 1)
        if not n or not self.weights:
            return 0.0, 0, n
        best: dict[int, tuple[int, float]] = {}
        for end, (length, weight) in automaton(self.weights).iter(folded):
            start = end - length + 1
            if length > best.get(start, (0, 0))[0]:
                best[start] = (length, weight)
        hits = {}
        total = 0.0
        for start, (length, weight) in best.items():
            if weight > 0:
                total += weight
                hits[folded[start : start + length]] = 1
        return total, len(hits), n

    def probability(self, total: float, hits: int, n: int) -> float:
        z = float(np.dot(self.coefficients, describe(total, hits, n)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def describe(total: float, hits: int, n: int) -> tuple[float, float, float, float]:
    """Constant, weight per root of length, distinct words per log of length, and length."""
    return 1.0, math.log1p(total / math.sqrt(n + 10)), math.log1p(hits) / math.log(n + 20), math.log1p(n) / 10


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[float, ...]:
    """Coefficients of a logistic regression with a small penalty, by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(b.tolist())


def counted(sample: DataFrame) -> DataFrame:
    """(entry, toxic, clean): labelled texts that hold each entry, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(entries(fold(text)))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([seen[k][x] for x in keys], pa.int64()) for k in (1, 0))],
                names=["entry", "toxic", "clean"],
            )

    parts = sample.select("text", "y").mapInArrow(run, "entry string, toxic bigint, clean bigint")
    return parts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, terms: int | None = None) -> Lexicon:
    """Lexicon and probability from labelled rows outside the held-out fold.

    At most ``rows`` labelled ids are used, the first by a hash, so the sample is bounded and the
    same each time; seven tenths of them weigh the entries and the rest fit the probability. The
    lexicon keeps every clear entry of the sample, or the ``terms`` clearest where a number is given. Without labels of both kinds it is empty and every
    score is one half.
    """
    known = (
        labels.where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id", "y").limit(rows)
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(10)))
    )
    # one text an id, the first by a hash: rows that repeat an id add nothing
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    found = texts.join(F.broadcast(known), texts._doc == known._id).groupBy("_id", "y", "part")
    sample = found.agg(F.min_by(F.coalesce("_text", F.lit("")), F.xxhash64("_text")).alias("text")).select("text", "y", "part")
    sizes = {y: n for y, n in sample.where("part < 7").groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Lexicon(())
    t, c = sizes[1], sizes[0]
    rate = (F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))).alias("rate")
    strong = counted(sample.where("part < 7")).where("toxic + clean >= 4").select("entry", "toxic", "clean", rate)
    clear = F.col("rate") - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = strong.withColumn("clear", clear).cache()
    most = lambda rows: rows if terms is None else rows.limit(terms)
    chosen = {r.entry: r.rate for r in most(strong.where("clear > 0.7").orderBy(F.desc("clear"), "entry")).collect()}
    # exceptions: longer entries that begin with a chosen one and are no likelier in toxic texts
    doubt = strong.where((F.col("rate") < 0.7) & (F.col("toxic") + F.col("clean") >= 6) & F.col("entry").endswith(" "))
    begins = [F.substring("entry", 1, k).isin([e for e in chosen if len(e) == k]) for k in sorted({len(e) for e in chosen})]
    if begins:
        within = functools.reduce(lambda a, b: a | b, begins)
        for r in most(doubt.where(within).orderBy("rate", "entry")).collect():
            chosen.setdefault(r.entry, 0.0)
    strong.unpersist()
    lexicon = Lexicon(tuple(sorted(chosen.items())))
    rest = measured(sample.where("part >= 7"), lexicon, "y").collect()
    y = np.array([r.y for r in rest], dtype=float)
    if len(set(y)) < 2:
        return lexicon
    x = np.array([describe(r.total, r.hits, r.n_words) for r in rest])
    return Lexicon(lexicon.weights, logistic(x, y))


def measured(rows: DataFrame, lexicon: Lexicon, id_col: str) -> DataFrame:
    """(id, total, hits, n_words, score) of every whole text, where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lexicon.measure(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.int64()), pa.array([lexicon.probability(*g) for g in got], pa.float64())],
                names=[id_col, "total", "hits", "n_words", "score"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, total double, hits bigint, n_words bigint, score double")


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, hits, n_words) for every row of ``docs``.

    A null or empty text has no words and takes the probability of a text without hits. Repeated
    rows give a row each; a null id stays null; an empty table gives no rows; other columns are not
    read. A word of any length counts whole.
    """
    done = measured(docs, learn(docs, labels, label), "doc_id")
    return done.select(
        "doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "n_words",
    )
