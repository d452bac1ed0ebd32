"""Byte-pair encoding of whole texts with a given vocabulary, and decoding.

A word is a doubly linked list of symbols. Every neighbouring pair that the merge table knows waits
in a priority queue ordered by rank, then place; a popped entry whose pair has changed since is
skipped as stale. Words repeat, so each task keeps the ids of recent words.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a task keeps; the store is emptied when full, which changes no result.
KEPT_WORDS = 400_000

# Fixed values of the vocabulary's own rules: white space, and what counts as one word.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


#: Stands for letters and numbers that only a newer Unicode knows, while a text is cut into words.
OTHER = "\ue000"

# Letters and numbers of the pattern library that the tokenizer library's pattern does not
# know (first and last code point), and capitals it lowers that the standard library does not know
# (first and last code point, first small letter).
UNKNOWN = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


@functools.cache
def newer_signs() -> tuple[dict[int, str], dict[int, str]]:
    """Code points that take no part in words as letters or numbers, and small letters of newer capitals."""
    unknown = {i: OTHER for a, z in UNKNOWN for i in range(a, z + 1)}
    return unknown, {i: chr(small + i - a) for a, z, small in CAPITALS for i in range(a, z + 1)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class KnownWords(dict):
    """Ids of recent words; a word that is not there yet is worked out."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids = self.ids_of(word)
        return ids


class Vocabulary:
    """Tokens, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        #: A pair of ids as one number (both under 2**20) to its rank, and the id that a rank makes.
        ranks = {self.ids[a] << 20 | self.ids[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.rank_of, self.made = ranks.get, [self.ids[a + b] for a, b in model["merges"]]
        letters = byte_letters()
        self.inner = [self.ids.get(x) for x in letters]
        self.last = [self.ids.get(x + self.end) for x in letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word = regex.compile(WORD)
        self.newer = frozenset(chr(i) for table in newer_signs() for i in table)
        self.known = KnownWords(self.word_ids)

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of one word, the pair of lowest rank merged first. A queue entry is rank and place in
        one number; ``pair[i]`` is the rank of the pair that begins at place i just now, -1 for none."""
        rank_of, made, push, pop, n = self.rank_of, self.made, heapq.heappush, heapq.heappop, len(symbols)
        pair = [rank_of(a << 20 | b, -1) for a, b in zip(symbols, symbols[1:])]
        shift = 12 if n < 4096 else 40
        queue = [rank << shift | i for i, rank in enumerate(pair) if rank >= 0]
        if not queue:
            return symbols
        heapq.heapify(queue)
        pair.append(-1)
        after, ahead, low = [*range(1, n + 1)], [*range(-1, n)], (1 << shift) - 1
        while queue:
            top = pop(queue)
            rank, i = top >> shift, top & low
            if pair[i] != rank:
                continue  # stale: one of the two is gone or another symbol now
            j = after[i]
            after[i] = k = after[j]
            symbols[i] = new = made[rank]
            symbols[j] = pair[j] = pair[i] = -1
            ahead[k] = i
            if k < n and (rank := rank_of(new << 20 | symbols[k], -1)) >= 0:
                pair[i] = rank
                push(queue, rank << shift | i)
            if (k := ahead[i]) >= 0:
                pair[k] = rank = rank_of(symbols[k] << 20 | new, -1)
                if rank >= 0:
                    push(queue, rank << shift | k)
        return [s for s in symbols if s >= 0]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers. A letter the vocabulary lacks has none."""
        signs = word.encode("utf-8")
        ids = [*map(self.inner.__getitem__, signs[:-1]), self.last[signs[-1]]]
        ids = self.merge([x for x in ids if x is not None] if None in ids else ids)
        return np.asarray(ids, dtype="<u4").tobytes()

    def plain_ids(self, text: str) -> bytes:
        # Runs of white space need no rewriting, as no word holds any. Letters are lowered one by
        # one: a sigma at the end of a word like any other.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isascii() or self.newer.isdisjoint(text):
            return b"".join(map(self.known.__getitem__, self.word.findall(text)))
        unknown, small = newer_signs()
        text = text.translate(small)
        spans = (m.span() for m in self.word.finditer(text.translate(unknown)))
        return b"".join(self.known[text[a:z]] for a, z in spans)

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain_ids(text)
        return b"".join(
            np.asarray([self.special[x]], dtype="<u4").tobytes() if x in self.special else self.plain_ids(x)
            for x in self.cut.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, one after the other, divided by a space as this
        vocabulary names no decoder that would join them."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: (id, n_tokens, ids), ids packed as little-endian 32-bit.

    ``path`` is the vocabulary file on every machine. No shuffle: each text is encoded where it is
    read. A null or empty text gives no ids; repeated rows give a row each; a null id stays null;
    an empty table gives no rows; other columns are not read, so their names do not matter. A text of
    any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            ids = [voc.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=[id_col, "n_tokens", "ids"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The decoded text of packed ids, beside what :func:`encode` returned. No ids, or null ones, give
    an empty text; repeated rows give a row each; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [voc.decode(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, "n_tokens", "ids").mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encoded and decoded, as digests of both."""
    done = decode(encode(docs, path), path)
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
