"""Encoding and decoding against the library that owns the vocabulary's format."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, and numbers 12 345.", "ΑΣ ΣΑΣ İI ŞŞ", "a<|endoftext|>b <|startoftext|> <|endoftext|", "I'll've don't'S they'RE",
    "é é ﬁ", "tab\tline\nfeed\x0b\x1c\x85　end", "汉字 かな 한국어 🙂👍🏽", "", None, "   ", "x" * 5000, "word " * 3000, "!!! $$$ *** a,b",
]


def test_equals_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    rows = [*enumerate(TEXTS), (None, "no id"), (0, TEXTS[0])]
    df = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id bigint, text string, n_tokens int, ids string")
    got = bpe.digests(df, PATH).collect()
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_a_full_store_of_words_changes_nothing(monkeypatch):
    voc = bpe.Vocabulary(PATH)
    want = [voc.encode(t or "") for t in TEXTS]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    small = bpe.Vocabulary(PATH)
    assert [small.encode(t or "") for t in TEXTS] == want


def test_merges_go_by_rank_and_skip_stale_pairs():
    voc = bpe.Vocabulary(PATH)

    def plain(symbols):  # the lowest rank over all pairs, leftmost first, again and again
        while True:
            found = [(voc.rank_of(a << 20 | b), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if voc.rank_of(a << 20 | b) is not None]
            if not found:
                return symbols
            rank, i = min(found)
            symbols = [*symbols[:i], voc.made[rank], *symbols[i + 2 :]]

    for word in ["the", "internationalisation", "aaaaaaaaaa", "thethethe", "überströmend", "é" * 30]:
        raw = word.encode()
        ids = [*(voc.inner[b] for b in raw[:-1]), voc.last[raw[-1]]]
        assert voc.merge([*ids]) == plain(ids), word


def test_every_code_point_like_the_library():
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    voc = bpe.Vocabulary(PATH)
    signs = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x110000)]]
    for at in range(0, len(signs), 64):
        part = signs[at : at + 64]
        text = " ".join(f"a{c}b 1{c}{c}2 {c}" for c in part)
        if list(np.frombuffer(voc.encode(text), "<u4")) != lib.encode(text, add_special_tokens=False).ids:
            for c in part:
                one = f"a{c}b 1{c}{c}2 {c}"
                assert list(np.frombuffer(voc.encode(one), "<u4")) == lib.encode(one, add_special_tokens=False).ids, hex(ord(c))
