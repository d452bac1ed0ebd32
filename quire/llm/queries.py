"""One registered query per operator, over its whole table with production settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import bpe, codes, fingerprints, jaccard, leaks, lines, periods, quality, quotes, substrings, suffixes, toxicity, vectors
from quire.llm.base import ready, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: fn(ready(spark), sf)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def vocabulary_path() -> str:
    """Where the installed vocabulary file lies; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_substrings", substrings.ORACLE)
def op1_substrings(spark, sf):
    return substrings.digests(table(spark, sf, "documents"))


@query("op2_quality")
def op2_quality(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_jaccard", jaccard.ORACLE)
def op3_jaccard(spark, sf):
    return jaccard.near_components(table(spark, sf, "documents"))


@query("op4_quotes")
def op4_quotes(spark, sf):
    done = quotes.conversations(table(spark, sf, "conversations"))
    body = F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256")
    return done.select("conv_id", "turn", "role", "thread", "reply_turn", "n_quotes", "n_linked", body)


@query("op5_leaks")
def op5_leaks(spark, sf):
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op6_vectors", vectors.ORACLE)
def op6_vectors(spark, sf):
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@query("op7_lines", lines.ORACLE)
def op7_lines(spark, sf):
    return lines.digests(table(spark, sf, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_suffixes")
def op9_suffixes(spark, sf):
    return suffixes.digests(table(spark, sf, "documents"))


@query("op10_bpe")
def op10_bpe(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), vocabulary_path())


@query("op11_periods")
def op11_periods(spark, sf):
    return periods.digests(table(spark, sf, "documents"))


@query("op12_codes", codes.ORACLE)
def op12_codes(spark, sf):
    return codes.digests(table(spark, sf, "embeddings"))


@query("op13_fingerprints")
def op13_fingerprints(spark, sf):
    return fingerprints.digests(table(spark, sf, "documents"))


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
