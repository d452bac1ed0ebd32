"""Benchmark decontamination by latent semantic retrieval.

Documents become sequences of term numbers of the benchmark's vocabulary, since no other word can
match an item. Passages of the whole corpus, weighted by TF-IDF, and the items give a term space
whose leading directions a randomised SVD finds in one pass: every task adds up its part of the
sketch. Items are banded by length, and a passage is a few times as long as the items it is scored
against. Passages close to an item in that space, and those that hold it word for word, are
candidates; a candidate counts when the longest common subsequence with the item is long and the
item's answer, its last words, is there too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import lasting

WORD = re.compile(r"[^\W_]+")
#: Directions kept, share of documents from which on a term is too common to retrieve by, and terms
#: every item keeps all the same.
RANK, EXTRA, COMMON, OWN_TERMS = 256, 16, 0.1, 8
#: Least cosine of a candidate, least share of the item in common order, least share of its answer.
COSINE, ORDER, ANSWER = 0.3, 0.6, 0.5
#: Words of the least block, and of those the directions are found from.
LEAST, SKETCH = 4, 32
#: Items that texts are scored against at a time, and members of a group that are added side by side.
ITEMS, TOGETHER = 1024, 64
SEED = 5


_APART = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def words(text: str | None) -> list[str]:
    text = (text or "").lower()
    if text.isascii():  # the same words, without the pattern
        return text.encode().translate(_APART).decode().split()
    return WORD.findall(text)


@dataclass
class Items:
    """The benchmark: ids and term numbers of its items, and the vocabulary. It is the stated query
    set, held whole by every task; empty items are left out."""

    ids: list[int]
    terms: list[np.ndarray]
    vocabulary: dict[str, int]

    @classmethod
    def of(cls, benchmark: DataFrame) -> Items:
        rows = [(r.item_id, words(r.text)) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").collect()]
        rows = [(i, w) for i, w in rows if w]
        vocabulary: dict[str, int] = {}
        terms = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int32) for _, w in rows]
        return cls([i for i, _ in rows], terms, vocabulary)

    def bands(self) -> list[tuple[int, np.ndarray]]:
        """Words of a block and the items scored by such blocks, blocks ascending. A passage of three
        blocks holds any item of its band whole wherever it lies: items of up to 16 words have no more
        than one block, others one to two."""
        out: dict[int, list[int]] = {}
        for j, t in enumerate(self.terms):
            size = LEAST
            while len(t) > (size if size < 32 else 2 * size):
                size *= 2
            out.setdefault(size, []).append(j)
        return [(size, np.array(out[size])) for size in sorted(out)]


def term_sequences(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, terms): term numbers of every whole text, -1 for words of no item."""
    vocabulary = items.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            out = [np.array([get(w, -1) for w in words(t)], np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, terms binary")


def document_counts(sequences: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, np.int64)
        for b in batches:
            total[-1] += b.num_rows
            for x in b.column(0).to_pylist():
                t = np.unique(np.frombuffer(x, np.int32))
                total[t[t >= 0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = sequences.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_terms + 1, np.int64)
    for t, n in rows:
        out[t] = n
    return out[:-1], int(out[-1])


def term_weights(items: Items, held: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency, 0 for common terms; an item's own rarest terms always count."""
    idf = np.log((n_docs + 1) / (held + 1)) + 0.1
    keep = held <= COMMON * n_docs
    for t in items.terms:
        own = np.unique(t)
        keep[own[np.argsort(held[own], kind="stable")[:OWN_TERMS]]] = True
    return np.where(keep, idf, 0.0)


def blocks_of(terms: list[bytes], weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block of each informative token, its term, first block of each document, blocks in all)."""
    seqs = [np.frombuffer(x, np.int32) for x in terms]
    counts = np.array([-(-len(s) // size) for s in seqs], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate(seqs) if seqs else np.empty(0, np.int32)
    lens = np.array([len(s) for s in seqs])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    block = np.repeat(first[:-1], lens) + place // size
    some = (flat >= 0) & (weights[flat] > 0)
    return block[some], flat[some], first, counts


def picked_sums(at: np.ndarray, rows: np.ndarray, pick: np.ndarray, n: int) -> np.ndarray:
    """Row i is the sum of ``rows[pick]`` over the places where ``at`` is i, places ascending.

    Groups are laid out by size, so the first members of all of them are added at once, then the
    second ones, and so on: far faster than one reduction a group. What large groups hold beyond
    that is summed group by group."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if not len(at):
        return out
    begin = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    size = np.diff(np.append(begin, len(at)))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    total = rows[pick[begin]]
    for k in range(1, min(int(size[0]), TOGETHER)):
        more = int(np.searchsorted(-size, -k, side="left"))
        total[:more] += rows[pick[begin[:more] + k]]
    for g in range(int(np.searchsorted(-size, -TOGETHER, side="left"))):
        for lo in range(begin[g] + TOGETHER, begin[g] + size[g], 4096):
            total[g] += rows[pick[lo : min(lo + 4096, begin[g] + size[g])]].sum(0)
    out[at[begin]] = total
    return out


def passage_sums(one: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each block with the next two of its document; ``first`` are the documents' first blocks, and the end."""
    x = np.empty_like(one)
    if len(one) > 2:
        np.add(one[:-2], one[1:-1], out=x[:-2])
        x[:-2] += one[2:]
    last = first[1:][first[1:] > first[:-1]] - 1
    before = first[1:][first[1:] > first[:-1] + 1] - 2
    x[last] = one[last]
    x[before] = one[before] + one[before + 1]
    return x


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[list[bytes]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).column("terms").to_pylist()


def added(sequences: DataFrame, part: Callable[[list[bytes]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of a matrix of fixed shape over all documents: added in each task, then row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for terms in slices(batches):
            part(terms, total)
        at = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array([total[i].astype(np.float32).tobytes() for i in at], pa.binary())], names=["row", "v"]
        )

    def summed(t: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("v").to_pylist())
        return pa.table([t.column("row").slice(0, 1), pa.array([v.tobytes()], pa.binary())], names=["row", "v"])

    parts = sequences.select("terms").mapInArrow(run, "row bigint, v binary").groupBy("row").applyInArrow(summed, "row bigint, v binary")
    out = np.zeros(shape)
    for r, v in parts.collect():
        out[r] = np.frombuffer(v)
    return out


def latent_terms(sequences: DataFrame, items: Items, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Rows of terms in the leading directions of corpus blocks and items. The items weigh as much
    in all as the corpus does, so what tells them apart is among these directions."""
    n, size = len(weights), SKETCH
    wide = min(n, rank + EXTRA)
    start = np.random.default_rng(SEED).standard_normal((n, wide)).astype(np.float32)

    weighted = start * weights[:, None].astype(np.float32)

    def sketch(terms: list[bytes], total: np.ndarray) -> None:
        block, term, first, _ = blocks_of(terms, weights, size)
        if not len(term):
            return
        square = np.bincount(block, weights[term] ** 2, minlength=int(first[-1]))
        # rows have length one: the weight of a block is divided out of the sum and out of what goes back
        b = picked_sums(block, weighted, term, int(first[-1])) / np.maximum(square, 1e-12)[:, None].astype(np.float32)
        order = np.argsort(term, kind="stable")
        held = np.unique(term)
        total[held] += picked_sums(np.searchsorted(held, term[order]), b, block[order], len(held))

    y = added(sequences, sketch, (n, wide)) * weights[:, None]
    ours = np.zeros((n, wide))
    for t in items.terms:  # one item at a time: no matrix of items by terms
        held, count = np.unique(t, return_counts=True)
        own = count * weights[held]
        own /= max(np.linalg.norm(own), 1e-12)
        ours[held] += np.outer(own, own @ start[held])
    y = y + max(np.linalg.norm(y) / max(np.linalg.norm(ours), 1e-12), 1.0) * ours
    # the leading eigenvectors of the rows' inner products from one sketch: y = (A'A) start
    shift = max(np.linalg.norm(y), 1e-12) * 1e-6
    y = y + shift * start
    core = start.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    some = values > values.max() * 1e-9
    directions, _, _ = np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    return (directions[:, :rank] * weights[:, None]).astype(np.float32)


def common_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each place of ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for x in b:
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & every
    return len(a) - row.bit_count()


def anchors(items: Items, held: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Items by their rarest term, with the first place of it."""
    out: dict[int, list[tuple[int, int]]] = {}
    for j, t in enumerate(items.terms):
        at = int(np.argmin(held[t]))
        out.setdefault(int(t[at]), []).append((j, at))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, in_order, answer): every document and item with a passage that
    retells the item: cosine in latent space, share of the item's words in common order, and share
    of the answer's (the last quarter's) informative words.

    Words are runs of letters and digits in lower case. Every whole text is scored against every item,
    which are the stated query set, by passages of the item's band; an item that stands in a text word
    for word is found whatever its cosine. Null and empty texts or items match
    nothing; rows with one id are one document, null ids included; equal items are reported each;
    an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = Items.of(benchmark)
    out = "doc_id bigint, item_id bigint, cosine double, in_order double, answer double"
    if not items.ids:
        return spark.createDataFrame([], out)
    sequences = lasting(term_sequences(docs, items), "terms")
    held, n_docs = document_counts(sequences, len(items.vocabulary))
    weights = term_weights(items, held, n_docs)
    latent = latent_terms(sequences, items, weights)
    # items of a band in bounded pieces, so that scores are a bounded matrix
    bands = [(size, own) for size, members in items.bands() for own in np.split(members, range(ITEMS, len(members), ITEMS))]
    places = anchors(items, held)
    rare = np.zeros(len(weights) + 1, bool)
    rare[list(places)] = True  # the last stays for -1
    queries = np.stack([latent[t].sum(0) for t in items.terms])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    exact = [t.tolist() for t in items.terms]
    answers = [{x for x in t[-max(3, len(t) // 4) :] if weights[x] > 0} or {*t} for t in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(at, 32) for at in range(0, big.num_rows, 32)):
                terms = b.column("terms").to_pylist()
                seqs = [np.frombuffer(x, np.int32) for x in terms]
                whole: dict[int, list[tuple[int, int]]] = {}
                for d, s in enumerate(seqs):
                    for p in np.flatnonzero(rare[s]).tolist():
                        for j, off in places[int(s[p])]:
                            if p >= off and np.array_equal(s[p - off : p - off + len(exact[j])], items.terms[j]):
                                whole.setdefault(j, []).append((d, p - off))
                found: dict[tuple[int, int], tuple] = {}
                now, x = 0, None
                for size, members in bands:
                    if size != now:
                        now = size
                        block, term, first, counts = blocks_of(terms, weights, size)
                        # a passage is a block with the next two of its document
                        x = passage_sums(picked_sums(block, latent, term, int(first[-1])), first)
                        owner, norm = np.repeat(np.arange(len(terms)), counts), np.sqrt(np.einsum("ij,ij->i", x, x))
                        some = np.flatnonzero(norm > 0)
                    if not len(x):
                        continue
                    near = np.argwhere(x[some] @ queries[members].T >= COSINE * norm[some][:, None])
                    pairs = {(int(some[i]), int(members[j])) for i, j in near.tolist()}
                    pairs.update((int(first[d]) + place // size, j) for j in members.tolist() for d, place in whole.get(j, ()))
                    for p, j in pairs:
                        d = int(owner[p])
                        lo = (p - int(first[d])) * size
                        passage = seqs[d][lo : lo + 3 * size]
                        passage = passage[passage >= 0].tolist()
                        if len(passage) < ORDER * len(exact[j]):
                            continue
                        order = common_order(exact[j], passage) / len(exact[j])
                        if order < ORDER:
                            continue
                        answer = len(answers[j] & {*passage}) / len(answers[j])
                        if answer < ANSWER:
                            continue
                        row = (order, answer, float(x[p] @ queries[j] / max(norm[p], 1e-12)))
                        found[d, j] = max(found.get((d, j), row), row)
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], items.ids[j], c, o, a) for (d, j), (o, a, c) in found.items()]
                if rows:
                    cols = zip(pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((x, pa.float64()) for x in ("cosine", "in_order", "answer"))]), zip(*rows))
                    yield pa.RecordBatch.from_pydict({f.name: pa.array(v, f.type) for f, v in cols})

    best = F.max_by(F.struct("cosine", "in_order", "answer"), F.struct("in_order", "answer", "cosine")).alias("best")
    rows = sequences.mapInArrow(run, out).groupBy("doc_id", "item_id").agg(best)
    return rows.select("doc_id", "item_id", "best.*")
