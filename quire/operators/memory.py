"""Translation memory: content keys, lookup, replies, retry, invalidation.

A sentence id is not a key of a place, as the same text has the same id everywhere. Places are
keyed by ``PLACE``; only the memory itself is keyed by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import session
from quire.functions import text as tx
from quire.operators import model
from quire.plans import scale
from quire.sources.views import PAGE

PLACE = [*PAGE, "block_index", "sent_index"]
MAX_RETRIES = 2


def with_cache_key(sentences: DataFrame, lang: str, model_name: str) -> DataFrame:
    return sentences.withColumn("cache_key", tx.cache_key("text", lang, model_name))


def cache_lookup(sentences: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``translation`` where the memory holds one; an empty entry counts as a miss."""
    hits = cache.where(F.col("translation") != "").select("cache_key", "translation")
    return sentences.join(hits, "cache_key", "left")


def pending_units(sentences: DataFrame, cache: DataFrame) -> DataFrame:
    """Sentences still to be translated, numbered from 1 on each page in reading order."""
    wanted = sentences.where(model.worth_translating())
    hits = cache.where(F.col("translation") != "").select("cache_key")
    open_units = wanted.join(hits, "cache_key", "left_anti")
    order = Window.partitionBy(*PAGE).orderBy("block_index", "sent_index")
    return open_units.withColumn("unit_id", F.row_number().over(order).cast("bigint"))


def cache_upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert or replace by key, the latest write wins; ``fresh`` wins a tie.

    An aggregate with a running maximum instead of a ranking: it is combined before the shuffle,
    so a key written millions of times costs one row per task.
    """
    both = cache.withColumn("_from", F.lit(0)).unionByName(fresh.withColumn("_from", F.lit(1)))
    latest = F.max(F.struct("updated_at", "_from", "translation", "source"))
    return both.groupBy("cache_key").agg(latest.alias("_w")).select(
        "cache_key", F.col("_w.source").alias("source"), F.col("_w.translation").alias("translation"),
        F.col("_w.updated_at").alias("updated_at"),
    )


def cache_drop(cache: DataFrame, keys: DataFrame) -> DataFrame:
    return cache.join(keys.select("cache_key"), "cache_key", "left_anti")


# The wording of hints and prompts, which replies and stored prompts depend on.
def unit_hint() -> Column:
    return (
        F.when(F.col("has_math"), " (contains an equation; reproduce the notation exactly)")
        .when(F.col("kind") == "title", " (slide heading)")
        .when(F.col("kind") == "fragment", " (label in a diagram or table cell)")
        .when(F.col("kind") == "caption", " (caption on a figure)")
        .otherwise("")
    )


def page_context(classified: DataFrame) -> DataFrame:
    """The text of a page as the model sees it: titles marked, furniture left out."""
    line = F.when(F.col("kind") == "title", F.concat(F.lit("# "), F.col("text"))).otherwise(F.col("text"))
    visible = F.when(F.col("kind") != "chrome", F.struct("block_index", line.alias("line")))
    lines = F.transform(F.array_sort(F.collect_list(visible)), lambda b: b["line"])
    context = F.array_join(lines, "\n")
    return classified.groupBy(*PAGE).agg(context.alias("_c")).select(
        *PAGE, F.when(F.col("_c") == "", "(no text)").otherwise(F.col("_c")).alias("context")
    )


def build_prompts(
    classified: DataFrame,
    units: DataFrame,
    sizes: DataFrame,
    glossary: DataFrame,
    keep_verbatim: Sequence[str] = (),
) -> DataFrame:
    """One prompt per page that has units.

    ``glossary`` has one ``terms`` text per deck, ``sizes`` the pages per deck. Both are copied
    over salts, as a deck may hold a large share of all pages.
    """
    pages = page_context(classified).join(model.page_title(classified), PAGE)
    numbered = F.concat(F.lit("["), F.col("unit_id").cast("string"), F.lit("]"), unit_hint(), F.lit(" "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("unit_id", numbered.alias("line")))), lambda u: u["line"])
    asked = units.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_units"), F.array_join(lines, "\n").alias("unit_lines"))
    decks = sizes.join(glossary, "deck_id", "left")
    rows = scale.salted_join(pages.join(asked, PAGE), decks, ["deck_id"], "page_index")

    # fixed wording, see unit_hint
    heading = F.concat(
        F.lit("Slide "), (F.col("page_index") + 1).cast("string"), F.lit(" of "), F.col("n_pages").cast("string"),
        F.when(F.col("title") != "", F.concat(F.lit(": "), F.col("title"))).otherwise(""),
    )
    terms = F.when(
        F.coalesce(F.col("terms"), F.lit("")) != "",
        F.concat(F.lit("\nGlossary established for this course. Use exactly:\n"), F.col("terms")),
    )
    verbatim = F.lit("\nAlways leave these unchanged: " + ", ".join(keep_verbatim)) if keep_verbatim else F.lit(None).cast("string")
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Deck: "), F.col("deck_id")),
        heading,
        F.lit("\nFull slide text, for context only:"),
        F.col("context"),
        terms,
        verbatim,
        F.concat(F.lit("\nTranslate these "), F.col("n_units").cast("string"), F.lit(" units:")),
        F.col("unit_lines"),
    )
    return rows.select(*PAGE, "n_units", prompt.alias("prompt"))


REPLY = T.StructType([
    T.StructField("units", T.MapType(T.StringType(), T.StringType())),
    T.StructField("glossary", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_bad", T.StringType()),
])


#: What reading adds to a reply.
READ = {"units", "glossary", "error"}


def read_replies(replies: DataFrame) -> DataFrame:
    """Parse the JSON of a reply: ``units``, ``glossary`` and ``error`` (null if it parsed).

    A reply may stand in a code fence. A reply without units is an empty answer, not an error. Replies that
    have been read stay as they are: write them down where they are looked at several times.
    """
    if READ <= set(replies.columns):
        return replies
    bare = tx.strip("reply")
    text = F.when(bare.startswith("```"), tx.replace_all(bare, r"\A```(?:json)?\s*|\s*```\z")).otherwise(bare)
    parsed = F.from_json(text, REPLY, {"columnNameOfCorruptRecord": "_bad"})
    broken = F.col("_r._bad").isNotNull() | F.col("_r").isNull() | (text == "")
    return (
        replies.withColumn("_r", parsed)
        .withColumn("error", F.when(broken, "Reply was not valid JSON"))
        .withColumn("units", F.when(F.col("error").isNull(), F.col("_r.units")))
        .withColumn("glossary", F.when(F.col("error").isNull(), F.col("_r.glossary")))
        .drop("_r")
    )


def parse_reply(replies: DataFrame) -> DataFrame:
    """One row per answered unit; ids like ``7`` and ``[7]`` are read, others left out.

    Where two spellings of one id stand in a reply, the later one counts.
    """
    keys = [c for c in replies.columns if c not in {"reply", *(READ if READ <= set(replies.columns) else ())}]
    bare = lambda e: tx.strip(F.btrim(tx.strip(e["key"]), F.lit("[]"))).try_cast("bigint")
    number = lambda e: F.coalesce(e["key"].try_cast("bigint"), bare(e))  # noqa: E731  a bare number at once
    entries = F.transform(
        F.map_entries("units"), lambda e: F.struct(number(e).alias("unit_id"), e["value"].alias("answer"))
    )
    read = read_replies(replies).select(*keys, F.filter(entries, lambda e: e["unit_id"].isNotNull()).alias("_e"))
    ids = F.transform("_e", lambda e: e["unit_id"])
    last = F.filter(
        "_e",
        lambda e, i: ~F.exists(F.slice(F.col("_e"), i + 2, F.size("_e")), lambda f: f["unit_id"] == e["unit_id"]),
    )
    unique = F.when(F.size(F.array_distinct(ids)) == F.size("_e"), F.col("_e")).otherwise(last)
    return read.select(*keys, F.inline(unique))


def parse_terms(replies: DataFrame) -> DataFrame:
    """One row per glossary proposal with a value."""
    keys = [c for c in replies.columns if c not in {"reply", *(READ if READ <= set(replies.columns) else ())}]
    rows = read_replies(replies).select(*keys, F.explode("glossary").alias("term", "translation"))
    return rows.where(F.coalesce(F.col("translation"), F.lit("")) != "")


def reply_errors(replies: DataFrame) -> DataFrame:
    return read_replies(replies).where("error IS NOT NULL").drop("reply", "units", "glossary")


def align_replies(units: DataFrame, answers: DataFrame) -> DataFrame:
    """Match answers to asked units: ``accepted``, ``missing`` (asked, not answered) and
    ``ignored`` (answered, not asked). Where both tables have an ``attempt``, each is matched by itself."""
    keys = [*PAGE, "unit_id", *(c for c in ("attempt",) if c in units.columns and c in answers.columns)]
    asked = units.select(*keys, F.lit(1).alias("_asked"))
    given = answers.select(*keys, "answer", F.lit(1).alias("_given"))
    status = (
        F.when(F.col("_asked").isNotNull() & F.col("_given").isNotNull(), "accepted")
        .when(F.col("_given").isNull(), "missing").otherwise("ignored")
    )
    return asked.join(given, keys, "full").withColumn("status", status).drop("_asked", "_given")


def retry_rounds(units: DataFrame, replies: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """The outcome of a page's rounds: only missing units are asked again, the first answer of a
    unit counts, an error ends the page, and what never came back has failed.

    ``replies`` carries ``attempt`` from 0. A round only takes place while units are missing, so
    a later reply to a unit that was answered before is never looked at; that is the minimum.
    """
    tries = replies.where(F.col("attempt") <= max_retries)
    # each reply is read once: what ends a page is found beside the answers, in the order of pages
    stop = F.min(F.when(F.col("error").isNotNull(), F.col("attempt"))).over(Window.partitionBy(*PAGE))
    read = read_replies(tries).withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("attempt") < F.col("_stop")))
    answers = parse_reply(read.drop("_stop"))
    first = answers.groupBy(*PAGE, "unit_id").agg(F.min(F.struct("attempt", "answer")).alias("_a"))
    return units.join(first, [*PAGE, "unit_id"], "left").select(
        *units.columns, F.col("_a.attempt").alias("attempt"), F.col("_a.answer").alias("answer"),
        F.col("_a").isNotNull().alias("answered"),
    )


def accept_checks(answered: DataFrame) -> DataFrame:
    """Judge each answer. Empty fails; far too long or left in the source language is flagged
    but kept; nothing is ever made up for a missing one."""
    text = F.coalesce(tx.strip("answer"), F.lit(""))
    got = F.col("answered") & (text != "")
    long = F.length(text) > 4 * F.length("text") + 60
    same = (text == F.col("text")) & (tx.word_count("text") > 3)
    return (
        answered.withColumn("translation", F.when(got, text))
        .withColumn("flagged", ~got | long | same)
        .withColumn("failed", ~got)
        .drop("answer")
    )


def page_results(lookups: DataFrame, accepted: DataFrame, replies: DataFrame) -> DataFrame:
    """Per page: translated, from memory, failed, errors, and whether all is well.

    An error is a reply that did not parse, or a round that left units missing and was followed
    by another.
    """
    cached = lookups.where(model.worth_translating()).groupBy(*PAGE).agg(F.count("translation").alias("from_cache"))
    done = accepted.groupBy(*PAGE).agg(
        F.count_if(~F.col("failed")).alias("translated"), F.count_if(F.col("failed")).alias("failed"),
        F.coalesce(F.max("attempt"), F.lit(-1)).alias("_last"),
        F.count_if(~F.col("answered")).alias("_never"),
    )
    stops = reply_errors(replies.where(F.col("attempt") <= MAX_RETRIES)).groupBy(*PAGE).agg(F.min("attempt").alias("_stop"))
    joined = cached.join(done, PAGE, "left").join(stops, PAGE, "left")
    # Rounds that left units missing: all before the stop, all but the last allowed one while
    # units never came back, else all before the one that answered the last unit.
    stopped = F.col("_stop").isNotNull() & (F.col("_never") > 0)
    rounds_short = (
        F.when(stopped, F.col("_stop"))
        .when(F.col("_never") > 0, F.lit(MAX_RETRIES))
        .otherwise(F.greatest(F.col("_last"), F.lit(0)))
    )
    errors = F.when(F.col("_last").isNull(), 0).otherwise(rounds_short + stopped.cast("int"))
    zero = F.lit(0)
    out = joined.select(
        *PAGE, F.coalesce("translated", zero).alias("translated"), "from_cache",
        F.coalesce("failed", zero).alias("failed"), errors.cast("bigint").alias("errors"),
    )
    return out.withColumn("ok", (F.col("failed") == 0) & (F.col("errors") == 0))


#: Terms that a task holds at once to look up the words of its sentences, about 100 bytes each.
HELD_TERMS = 500_000


def _tokens(c: str) -> Column:
    """Word tokens of a text in order, case folded."""
    return F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _with_words(rows: DataFrame) -> DataFrame:
    """A row for each word of ``text`` and each two neighbouring words, without repeats, as ``_key``."""
    following = F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0)))
    pairs = F.transform(following, lambda t, i: F.concat(t, F.lit(" "), F.get("_t", i + 1)))
    return rows.withColumn("_t", _tokens("text")).select(*rows.columns, F.explode(F.array_distinct(F.concat("_t", pairs))).alias("_key"))


def term_pattern(term: str | Column) -> Column:
    """The term as a whole word, any case; its own characters mean only themselves."""
    col = F.col(term) if isinstance(term, str) else term
    quoted = F.regexp_replace(col, F.lit(r"([^\p{L}\p{N}_\s])"), F.lit(r"\\$1"))
    return F.concat(F.lit(r"(?iuU)\b"), quoted, F.lit(r"\b"))


def term_hits(sentences: DataFrame, terms: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """Translatable sentences that contain a term, one row per (sentence, term).

    Terms times sentences would be a cross product. A match at word boundaries always has the
    term's first word as a whole word of the sentence, or its first two side by side, so these are
    the join key and only the candidates are held against the whole term; by the first word alone, all
    terms that begin with a frequent word would be candidates of every sentence that has it. A term
    without any letter or digit has no first word and matches nothing.

    Up to ``held`` terms are held by each task, which looks the words of its sentences up where they
    are: neither words nor texts are shuffled. With more terms, places and words are dealt out to them
    and the text is attached to the candidates afterwards.
    """
    first = F.array_join(F.slice("_t", 1, 2), " ")
    keyed = terms.withColumn("_t", _tokens("term")).where(F.size("_t") > 0).select(*terms.columns, first.alias("_key"))
    keyed = session.written(keyed, "terms")
    texts = sentences.where(model.worth_translating())
    if keyed.count() <= held:
        found = _with_words(texts).join(F.broadcast(keyed), "_key")
    else:
        texts = session.written(texts, "texts")
        words = _with_words(texts.select(*PLACE, "text")).select(*PLACE, "_key")
        found = texts.join(words.join(keyed, "_key"), PLACE)
    return found.where(F.rlike("text", term_pattern("term"))).select(*sentences.columns, *terms.columns)


def term_invalidation(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentences to be done again after terms were pinned, each once, with its memory key."""
    hits = term_hits(sentences, terms)
    return hits.groupBy(*PLACE, "cache_key").agg(F.count(F.lit(1)).alias("terms"))


def affected_pages(invalid: DataFrame) -> DataFrame:
    return invalid.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("sentences"))


def manual_edit(sentences: DataFrame, edits: DataFrame) -> DataFrame:
    """The user's own wording replaces what was there and clears the flag.

    ``edits`` is keyed by place; the edited rows also belong in the memory, see ``edit_entries``.
    """
    e = edits.select(*PLACE, F.col("translation").alias("_new"))
    hit = F.col("_new").isNotNull()
    return (
        sentences.join(e, PLACE, "left")
        .withColumn("translation", F.coalesce("_new", "translation"))
        .withColumn("edited", hit)
        .withColumn("flagged", F.when(hit, False).otherwise(F.col("flagged")))
        .drop("_new")
    )


def edit_entries(sentences: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """Memory rows of the edits, for ``cache_upsert``."""
    e = edits.select(*PLACE, F.col("translation"))
    return sentences.select(*PLACE, "cache_key", F.col("text").alias("source")).join(e, PLACE).select(
        "cache_key", "source", "translation", at.alias("updated_at")
    )


def page_progress(translated: DataFrame) -> DataFrame:
    """Per page: units, those without a translation, those flagged."""
    return translated.where(model.worth_translating()).groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("translation").isNull()).alias("pending"),
        F.count_if("flagged").alias("flagged"),
    )


def deck_progress(progress: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per deck: pages done and pages in all; a page without units is done."""
    per_deck = progress.groupBy("deck_id").agg(F.count_if(F.col("pending") > 0).alias("_open"))
    return sizes.join(per_deck, "deck_id", "left").select(
        "deck_id", (F.col("n_pages") - F.coalesce("_open", F.lit(0))).alias("done"), F.col("n_pages").alias("total")
    )


ModelCall = Callable[[str], str]


def batch_infer(prompts: DataFrame, complete: ModelCall) -> DataFrame:
    """Ask a model once per prompt row, in the tasks, Arrow batch by batch.

    ``complete`` is any callable from prompt to reply. A call that raises gives an error row and
    the rest goes on. The number of calls at one time is the number of partitions. Write the
    result down (``session.written``) before it is read twice, or the model is asked twice.
    """
    keys = [f for f in prompts.schema.fields if f.name != "prompt"]
    schema = T.StructType([*keys, T.StructField("reply", T.StringType()), T.StructField("call_error", T.StringType())])
    names = [f.name for f in keys]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    replies.append(complete(prompt))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - one failed call must not fail the job
                    replies.append(None)
                    errors.append(str(exc))
            yield batch[names].assign(reply=replies, call_error=errors)

    return prompts.mapInPandas(ask, schema)


def translate_pages(
    units: DataFrame, ask: Callable[[DataFrame], DataFrame], complete: ModelCall, max_retries: int = MAX_RETRIES
) -> tuple[DataFrame, DataFrame]:
    """Ask for every unit, ask again for what is missing, and judge what came back.

    ``ask`` makes prompts (one row per page) of the units still open. A round asks only pages that
    have open units and gave no error so far; its replies are written before they are read, so no
    model is asked twice for a lost executor. Returns the judged units and all replies.
    """
    replies = None
    open_units = units
    for attempt in range(max_retries + 1):
        prompts = ask(open_units)
        asked = batch_infer(prompts.select(*PAGE, "prompt"), complete).withColumn("attempt", F.lit(attempt).cast("bigint"))
        reply = F.coalesce("reply", F.concat(F.lit("call failed: "), F.col("call_error")))
        given = session.written(read_replies(asked.select(*PAGE, "attempt", reply.alias("reply"))), "replies")
        replies = given if replies is None else replies.unionByName(given)
        if attempt < max_retries:
            bad = reply_errors(given).select(*PAGE).distinct()
            left = open_units.join(parse_reply(given).select(*PAGE, "unit_id").distinct(), [*PAGE, "unit_id"], "left_anti")
            open_units = session.written(left.join(bad, PAGE, "left_anti"), "open_units")
            if open_units.isEmpty():
                break
    return accept_checks(retry_rounds(units, replies, max_retries)), replies.drop(*READ)


def accepted_entries(judged: DataFrame, at: Column) -> DataFrame:
    """Memory rows of what was accepted, for ``cache_upsert``; what failed leaves none."""
    return judged.where("NOT failed").select("cache_key", F.col("text").alias("source"), "translation", at.alias("updated_at"))


def lock_terms(
    translated: DataFrame, cache: DataFrame, terms: DataFrame, keyed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What pinning terms does: the sentences that use them without their translation, the memory
    without their keys, and the pages that have such sentences, with their number.

    ``keyed`` are the same sentences with their keys where they are at hand before the memory is looked
    up, so that finding the terms does not wait for it."""
    invalid = term_invalidation(translated if keyed is None else keyed, terms)
    hit = F.col("_hit").isNotNull()
    cleared = translated.join(invalid.select(*PLACE, F.lit(1).alias("_hit")), PLACE, "left").select(
        *[c for c in translated.columns if c not in ("translation", "flagged")],
        F.when(~hit, F.col("translation")).alias("translation"), (F.col("flagged") & ~hit).alias("flagged"),
    )
    return cleared, cache_drop(cache, invalid.select("cache_key").distinct()), affected_pages(invalid)


def edit_memory(sentences: DataFrame, cache: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """The memory after the user's own wording was written to it."""
    return cache_upsert(cache, edit_entries(sentences, edits, at))


def retranslated_memory(units: DataFrame, reduced: DataFrame, answers: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """After asking again for chosen places: the judged units, failed ones flagged, and the memory,
    which had lost their keys, with the answers that count. ``answers`` is (place, answer)."""
    joined = units.join(answers.select(*PLACE, "answer"), PLACE, "left").withColumn("answered", F.col("answer").isNotNull())
    judged = accept_checks(joined)
    return judged, cache_upsert(reduced, accepted_entries(judged, at))


def infer_once_per_text(units: DataFrame) -> DataFrame:
    """One unit per distinct memory key, so that a sentence repeated anywhere is asked once."""
    return units.groupBy("cache_key").agg(F.min(F.struct(*PLACE, "text")).alias("_u")).select("cache_key", "_u.*")


def retranslate(sentences: DataFrame, chosen: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ask again for chosen places whatever is remembered: the units, and the memory without
    their keys."""
    picked = sentences.join(chosen.select(*PLACE), PLACE, "left_semi").where(model.worth_translating())
    return picked.withColumn("unit_id", F.lit(1).cast("bigint")), cache_drop(cache, picked)
