"""Queries on the translation memory, with their oracles."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from quire import session
from quire.operators import calls
from quire.operators import memory as mem
from quire.oracles import base as o
from quire.oracles import tables  # noqa: F401 - registers the views
from quire.plans import stages
from quire.sources import derived, views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

UNIT = ["deck_id", "page_index", "block_index", "sent_index"]
UNIT_SQL = ", ".join(UNIT)


def query(name: str, sql: str | None = None, *needs: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = o.with_views(sql, *needs)
        return fn

    return keep


@query("cache_key", f"SELECT {UNIT_SQL}, cache_key FROM keyed", "keyed")
def cache_key(spark, sf):
    return derived.keyed_sentences(stages.sentences(spark, sf)).select(*UNIT, "cache_key")


@query("cache_lookup", f"SELECT {UNIT_SQL}, translation FROM translated", "translated")
def cache_lookup(spark, sf):
    s = stages.written_sentences(spark, sf)
    return mem.cache_lookup(derived.keyed_sentences(s), derived.cache(s)).select(*UNIT, "translation")


@query("pending_units", f"SELECT {UNIT_SQL}, unit_id, text FROM pending", "pending")
def pending_units(spark, sf):
    return derived.pending(stages.written_sentences(spark, sf)).select(*UNIT, "unit_id", "text")


def fresh_entries(spark, sf):
    """Accepted answers as memory rows, one per place; the same text may come up many times."""
    s = stages.written_sentences(spark, sf)
    units = stages.written_units(s)
    done = mem.accept_checks(mem.retry_rounds(units, derived.replies(units)))
    return derived.cache(s), done.where("NOT failed").select(
        "cache_key", F.col("text").alias("source"), "translation",
        (2000 + F.col("page_index") * 1000 + F.col("block_index")).alias("updated_at"),
    )


@query(
    "cache_upsert",
    """SELECT cache_key, arg_max(source, (updated_at, fresh, translation)) AS source,
         arg_max(translation, (updated_at, fresh, translation)) AS translation, max(updated_at) AS updated_at
       FROM (SELECT cache_key, source, translation, updated_at, 0 AS fresh FROM cache
             UNION ALL SELECT cache_key, text, new_translation, 2000 + page_index * 1000 + block_index, 1 FROM accepted WHERE NOT failed)
       GROUP BY 1""",
    "cache", "accepted",
)
def cache_upsert(spark, sf):
    return mem.cache_upsert(*fresh_entries(spark, sf))


@query("cache_drop", "SELECT cache_key, source FROM cache WHERE substr(cache_key, 1, 1) NOT IN ('0', '1', '2')", "cache")
def cache_drop(spark, sf):
    memory = session.written(derived.cache(stages.sentences(spark, sf)), "memory")
    gone = memory.where(F.substring("cache_key", 1, 1).isin("0", "1", "2"))
    return mem.cache_drop(memory, gone).select("cache_key", "source")


@query("cache_stats", "SELECT count(*) AS entries FROM cache", "cache")
def cache_stats(spark, sf):
    return derived.cache(stages.sentences(spark, sf)).agg(F.count(F.lit(1)).alias("entries"))


_HINT = """CASE WHEN has_math THEN ' (contains an equation; reproduce the notation exactly)'
  WHEN kind = 'title' THEN ' (slide heading)' WHEN kind = 'fragment' THEN ' (label in a diagram or table cell)'
  WHEN kind = 'caption' THEN ' (caption on a figure)' ELSE '' END"""


@query("unit_hints", f"SELECT {UNIT_SQL}, {_HINT} AS hint FROM sentences WHERE kind NOT IN ('chrome', 'code')", "sentences")
def unit_hints(spark, sf):
    s = stages.sentences(spark, sf).where("kind NOT IN ('chrome', 'code')")
    return s.select(*UNIT, mem.unit_hint().alias("hint"))


_CONTEXT = """SELECT deck_id, page_index, coalesce(nullif(string_agg(CASE WHEN kind = 'title' THEN '# ' ELSE '' END || text, chr(10)
  ORDER BY block_index) FILTER (kind <> 'chrome'), ''), '(no text)') AS context FROM rescued GROUP BY 1, 2"""


@query("page_context", _CONTEXT, "rescued")
def page_context(spark, sf):
    return mem.page_context(stages.classified(spark, sf)).select("deck_id", "page_index", "context")


def deck_terms(spark, sf, limit=60):
    """The glossary text of every deck: the terms that apply in its folder, the first ``limit``."""
    from quire.operators import glossary as gl

    homes = derived.deck_homes(spark, sf)
    leaves = homes.select("folder").distinct()
    texts = gl.prompt_terms(gl.resolve_scoped(leaves, derived.glossary(spark, sf)), limit)
    return homes.join(texts, homes.folder == texts.leaf, "left").select("deck_id", "terms")


o.view("deck_terms", """
SELECT deck_id, string_agg(term || ' -> ' || translation, chr(10) ORDER BY rn) AS terms FROM (
  SELECT deck_id, term, translation, row_number() OVER (PARTITION BY deck_id ORDER BY locked DESC, inherited, count DESC, term) AS rn
  FROM deck_homes JOIN resolved ON leaf = folder) WHERE rn <= 60 GROUP BY 1
""", "deck_homes", "resolved")

o.view("prompts", f"""
SELECT deck_id, page_index, n_units, 'Deck: ' || deck_id || chr(10) || 'Slide ' || (page_index + 1) || ' of ' || n_pages
  || CASE WHEN title <> '' THEN ': ' || title ELSE '' END || chr(10) || chr(10) || 'Full slide text, for context only:' || chr(10) || context
  || CASE WHEN coalesce(terms, '') <> '' THEN chr(10) || chr(10) || 'Glossary established for this course. Use exactly:' || chr(10) || terms ELSE '' END
  || chr(10) || chr(10) || 'Always leave these unchanged: SQL, Java'
  || chr(10) || chr(10) || 'Translate these ' || n_units || ' units:' || chr(10) || unit_lines AS prompt
FROM ({_CONTEXT}) JOIN (SELECT deck_id, page_index, coalesce(arg_min(text, block_index) FILTER (kind = 'title'), '') AS title FROM rescued GROUP BY 1, 2)
  USING (deck_id, page_index)
JOIN (SELECT deck_id, page_index, count(*) AS n_units, string_agg('[' || unit_id || ']' || {_HINT} || ' ' || text, chr(10) ORDER BY unit_id) AS unit_lines
      FROM pending GROUP BY 1, 2) USING (deck_id, page_index)
JOIN deck_sizes USING (deck_id) LEFT JOIN deck_terms USING (deck_id)
""", "rescued", "pending", "deck_sizes", "deck_terms")


def prompts(spark, sf):
    c = stages.written_blocks(spark, sf)
    units = stages.written_units(session.written(stages.sentences_of(c), "sentences"))
    return mem.build_prompts(c, units, views.deck_sizes(spark, sf), deck_terms(spark, sf), ["SQL", "Java"])


@query("build_prompts", "SELECT deck_id, page_index, n_units, prompt FROM prompts", "prompts")
def build_prompts(spark, sf):
    return prompts(spark, sf).select("deck_id", "page_index", "n_units", "prompt")


def unit_replies(spark, sf):
    units = stages.written_units(stages.written_sentences(spark, sf))
    return units, derived.replies(units)


def written_replies(replies):
    """Replies as they were read, written once for work that looks at them more than once."""
    return session.written(mem.read_replies(replies).drop("reply"), "read_replies")


@query(
    "parse_reply",
    """SELECT deck_id, page_index, attempt, unit_id, answer, NULL AS error FROM answers
       UNION ALL SELECT deck_id, page_index, attempt, NULL, NULL, 'Reply was not valid JSON' FROM reply_errors""",
    "answers", "reply_errors",
)
def parse_reply(spark, sf):
    replies = written_replies(unit_replies(spark, sf)[1])
    good = mem.parse_reply(replies).withColumn("error", F.lit(None).cast("string"))
    both = good.unionByName(mem.reply_errors(replies), allowMissingColumns=True)
    return both.select("deck_id", "page_index", "attempt", "unit_id", "answer", "error")


@query(
    "parse_reply_terms",
    """SELECT DISTINCT deck_id, page_index, attempt, 'Term' || (page_index % 50) AS term, 't' || page_index AS translation
       FROM pending, (SELECT unnest([0, 1, 2])::BIGINT AS attempt)
       WHERE NOT (page_index % 11 = 5 AND attempt = 1) AND NOT (page_index % 29 = 7 AND attempt = 0)""",
    "pending",
)
def parse_reply_terms(spark, sf):
    _, replies = unit_replies(spark, sf)
    return mem.parse_terms(replies).select("deck_id", "page_index", "attempt", "term", "translation")


@query(
    "align_replies",
    """SELECT deck_id, page_index, unit_id, attempt, answer,
         CASE WHEN p.asked AND a.given THEN 'accepted' WHEN p.asked THEN 'missing' ELSE 'ignored' END AS status
       FROM (SELECT deck_id, page_index, unit_id, unnest([0, 1, 2])::BIGINT AS attempt, true AS asked FROM pending) p
       FULL JOIN (SELECT deck_id, page_index, unit_id, attempt, answer, true AS given FROM answers) a
       USING (deck_id, page_index, unit_id, attempt)""",
    "pending", "answers",
)
def align_replies(spark, sf):
    units, replies = unit_replies(spark, sf)
    asked = units.withColumn("attempt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))
    return mem.align_replies(asked, mem.parse_reply(replies)).select("deck_id", "page_index", "unit_id", "attempt", "answer", "status")


@query("retry_rounds", f"SELECT {UNIT_SQL}, unit_id, attempt, answer, answered FROM rounds", "rounds")
def retry_rounds(spark, sf):
    return mem.retry_rounds(*unit_replies(spark, sf)).select(*UNIT, "unit_id", "attempt", "answer", "answered")


@query(
    "accept_checks",
    f"SELECT {UNIT_SQL}, unit_id, new_translation AS translation, new_flagged AS flagged, failed FROM accepted",
    "accepted",
)
def accept_checks(spark, sf):
    done = mem.accept_checks(mem.retry_rounds(*unit_replies(spark, sf)))
    return done.select(*UNIT, "unit_id", "translation", "flagged", "failed")


@query(
    "page_results",
    """SELECT deck_id, page_index, translated, from_cache, failed, errors, failed = 0 AND errors = 0 AS ok FROM (
         SELECT deck_id, page_index, from_cache, coalesce(translated, 0) AS translated, coalesce(failed, 0) AS failed,
           CASE WHEN never IS NULL THEN 0
                WHEN never > 0 AND stop IS NOT NULL THEN stop + 1 WHEN never > 0 THEN 2 ELSE last END AS errors
         FROM (SELECT deck_id, page_index, count(translation) AS from_cache FROM translated
               WHERE kind NOT IN ('chrome', 'code') GROUP BY 1, 2)
         LEFT JOIN (SELECT deck_id, page_index, count(*) FILTER (NOT failed) AS translated, count(*) FILTER (failed) AS failed,
                      count(*) FILTER (NOT answered) AS never, max(attempt) AS last FROM accepted GROUP BY 1, 2) USING (deck_id, page_index)
         LEFT JOIN (SELECT deck_id, page_index, min(attempt) AS stop FROM reply_errors GROUP BY 1, 2) USING (deck_id, page_index))""",
    "translated", "accepted", "reply_errors",
)
def page_results(spark, sf):
    s = stages.written_sentences(spark, sf)
    units = stages.written_units(s)
    replies = written_replies(derived.replies(units))
    looked = mem.cache_lookup(derived.keyed_sentences(s), derived.cache(s))
    done = mem.accept_checks(mem.retry_rounds(units, replies))
    return mem.page_results(looked, done, replies).select(
        "deck_id", "page_index", "translated", "from_cache", "failed", "errors", "ok"
    )


def pinned_terms(spark, sf):
    return derived.glossary(spark, sf).where("locked").select("term").distinct()


# Every non-word character is set between marks, so a whole word is a plain substring.
o.view("term_hits", r"""
SELECT s.* EXCLUDE (marked), t.term
FROM (SELECT *, chr(2) || regexp_replace(lower(text), '([^\p{L}\p{N}_])', chr(2) || '\1' || chr(2), 'g') || chr(2) AS marked
      FROM keyed WHERE kind NOT IN ('chrome', 'code')) s
JOIN (SELECT DISTINCT term, chr(2) || replace(term, ' ', chr(2) || ' ' || chr(2)) || chr(2) AS needle
      FROM glossary WHERE locked) t ON contains(s.marked, t.needle)
""", "keyed", "glossary")


@query(
    "term_invalidation",
    f"SELECT {UNIT_SQL}, cache_key, count(*) AS terms FROM term_hits GROUP BY ALL",
    "term_hits",
)
def term_invalidation(spark, sf):
    s = derived.keyed_sentences(stages.sentences(spark, sf))
    return mem.term_invalidation(s, pinned_terms(spark, sf)).select(*UNIT, "cache_key", "terms")


o.view("edits", """
SELECT deck_id, page_index, block_index, sent_index, 'edit:' || sentence_id AS translation FROM sentences
WHERE (block_index * 31 + sent_index * 7 + page_index) % 20 = 3
""", "sentences")


def edits(sentences):
    chosen = sentences.where((F.col("block_index") * 31 + F.col("sent_index") * 7 + F.col("page_index")) % 20 == 3)
    return chosen.select(*mem.PLACE, F.concat(F.lit("edit:"), F.col("sentence_id")).alias("translation"))


@query(
    "manual_edit",
    f"""SELECT {UNIT_SQL}, coalesce(e.translation, t.translation) AS translation, e.translation IS NOT NULL AS edited,
          CASE WHEN e.translation IS NOT NULL THEN false ELSE flagged END AS flagged
        FROM translated t LEFT JOIN edits e USING ({UNIT_SQL})""",
    "translated", "edits",
)
def manual_edit(spark, sf):
    s = stages.written_sentences(spark, sf)
    return mem.manual_edit(derived.translated(s), edits(s)).select(*UNIT, "translation", "edited", "flagged")


@query(
    "page_progress",
    """SELECT deck_id, page_index, count(*) AS units, count(*) FILTER (translation IS NULL) AS pending,
         count(*) FILTER (flagged) AS flagged FROM translated WHERE kind NOT IN ('chrome', 'code') GROUP BY 1, 2""",
    "translated",
)
def page_progress(spark, sf):
    p = mem.page_progress(derived.translated(stages.written_sentences(spark, sf)))
    return p.select("deck_id", "page_index", "units", "pending", "flagged")


@query(
    "deck_progress",
    """SELECT deck_id, n_pages - coalesce(open, 0) AS done, n_pages AS total FROM deck_sizes LEFT JOIN (
         SELECT deck_id, count(DISTINCT page_index) AS open FROM translated
         WHERE kind NOT IN ('chrome', 'code') AND translation IS NULL GROUP BY 1) USING (deck_id)""",
    "translated", "deck_sizes",
)
def deck_progress(spark, sf):
    p = mem.page_progress(derived.translated(stages.written_sentences(spark, sf)))
    return mem.deck_progress(p, views.deck_sizes(spark, sf))


def echo_model(prompt: str) -> str:
    """A stand-in for a model: gives every numbered unit back in quotes."""
    asked = prompt.rsplit(" units:\n", 1)[1]
    hints = "contains an equation; reproduce the notation exactly|slide heading|label in a diagram or table cell|caption on a figure"
    found = re.findall(rf"^\[(\d+)\](?: \((?:{hints})\))? (.*)$", asked, re.M)
    return json.dumps({"units": {n: f"«{text}»" for n, text in found}, "glossary": {}})


@query(
    "batch_infer",
    "SELECT deck_id, page_index, unit_id, '«' || text || '»' AS answer FROM pending",
    "pending",
)
def batch_infer(spark, sf):
    replies = mem.batch_infer(prompts(spark, sf), echo_model)
    answers = mem.parse_reply(replies.drop("call_error", "n_units"))
    return answers.select("deck_id", "page_index", "unit_id", "answer")


@query(
    "infer_logged",
    "SELECT deck_id, page_index, unit_id, '«' || text || '»' AS answer, 0 AS calls FROM pending",
    "pending",
)
def infer_logged(spark, sf):
    """The prompts asked through the log of replies, twice: the second run takes every reply from the log."""
    log, asked = session.work_path(spark, "replies-log"), session.written(prompts(spark, sf), "prompts")
    calls.infer_logged(asked, echo_model, log)
    replies = calls.infer_logged(asked, echo_model, log)
    answers = mem.parse_reply(replies.drop("call_error", "n_units"))
    return answers.select("deck_id", "page_index", "unit_id", "answer", F.col("calls").cast("int").alias("calls"))


@query(
    "retranslate_one",
    "SELECT deck_id, page_index, block_index, sent_index, '«' || text || '»' AS answer FROM edits JOIN sentences "
    "USING (deck_id, page_index, block_index, sent_index) WHERE kind NOT IN ('chrome', 'code')",
    "edits", "sentences",
)
def retranslate_one(spark, sf):
    s = stages.written_sentences(spark, sf)
    units, _ = mem.retranslate(derived.keyed_sentences(s), edits(s), derived.cache(s))
    ask = units.select(*mem.PLACE, F.concat(F.lit("Translate these 1 units:\n[1]"), mem.unit_hint(), F.lit(" "), F.col("text")).alias("prompt"))
    answers = mem.parse_reply(mem.batch_infer(ask, echo_model).drop("call_error"))
    return answers.where("unit_id = 1").select(*UNIT, "answer")


def forgetful_model(prompt: str) -> str:
    """A stand-in that leaves out the last unit whenever it is asked for several."""
    reply = json.loads(echo_model(prompt))
    if len(reply["units"]) > 1:
        reply["units"].popitem()
    return json.dumps(reply)


def translated_pages(spark, sf):
    """Standing inputs of the loop, and its outcome: the memory before, and the judged units."""
    pages = stages.written_blocks(spark, sf)
    s = session.written(stages.sentences_of(pages), "sentences")
    units = stages.written_units(s)
    terms = session.written(deck_terms(spark, sf), "deck_terms")
    sizes = views.deck_sizes(spark, sf)
    judged, _ = mem.translate_pages(units, lambda rest: mem.build_prompts(pages, rest, sizes, terms), forgetful_model)
    return derived.cache(s), judged


@query(
    "translate_pages",
    f"""SELECT {UNIT_SQL}, unit_id, CASE WHEN unit_id > 1 AND unit_id = n THEN 1 ELSE 0 END AS attempt,
          '«' || text || '»' AS translation, false AS flagged, false AS failed
        FROM (SELECT *, count(*) OVER (PARTITION BY deck_id, page_index) AS n FROM pending)""",
    "pending",
)
def translate_pages(spark, sf):
    _, judged = translated_pages(spark, sf)
    return judged.select(*UNIT, "unit_id", "attempt", "translation", "flagged", "failed")


@query(
    "translate_memory",
    """SELECT cache_key, arg_max(source, updated_at) AS source, arg_max(translation, updated_at) AS translation, max(updated_at) AS updated_at FROM (
         SELECT cache_key, source, translation, updated_at FROM cache
         UNION ALL SELECT cache_key, text, '«' || text || '»', 5000 FROM pending) GROUP BY 1""",
    "cache", "pending",
)
def translate_memory(spark, sf):
    """The memory after the loop has written back to it."""
    memory, judged = translated_pages(spark, sf)
    return mem.cache_upsert(memory, mem.accepted_entries(judged, F.lit(5000).cast("bigint")))


def locked(spark, sf):
    s = stages.written_sentences(spark, sf)
    return mem.lock_terms(derived.translated(s), derived.cache(s), pinned_terms(spark, sf), derived.keyed_sentences(s))


@query(
    "lock_clears",
    f"""SELECT {UNIT_SQL}, CASE WHEN h.n IS NULL THEN translation END AS translation, flagged AND h.n IS NULL AS flagged
        FROM translated LEFT JOIN (SELECT {UNIT_SQL}, count(*) AS n FROM term_hits GROUP BY ALL) h USING ({UNIT_SQL})""",
    "translated", "term_hits",
)
def lock_clears(spark, sf):
    return locked(spark, sf)[0].select(*UNIT, "translation", "flagged")


@query(
    "lock_memory",
    "SELECT cache_key, source, translation, updated_at FROM cache WHERE cache_key NOT IN (SELECT cache_key FROM term_hits)",
    "cache", "term_hits",
)
def lock_memory(spark, sf):
    return locked(spark, sf)[1].select("cache_key", "source", "translation", "updated_at")


@query(
    "lock_pages",
    f"SELECT deck_id, page_index, count(*) AS sentences FROM (SELECT DISTINCT {UNIT_SQL} FROM term_hits) GROUP BY 1, 2",
    "term_hits",
)
def lock_pages(spark, sf):
    return locked(spark, sf)[2].select("deck_id", "page_index", "sentences")


@query(
    "edit_memory",
    """SELECT cache_key, arg_max(source, updated_at) AS source, arg_max(translation, updated_at) AS translation, max(updated_at) AS updated_at FROM (
         SELECT cache_key, source, translation, updated_at FROM cache
         UNION ALL SELECT cache_key, text, e.translation, 5000 FROM keyed JOIN edits e USING (deck_id, page_index, block_index, sent_index))
       GROUP BY 1""",
    "cache", "keyed", "edits",
)
def edit_memory(spark, sf):
    s = stages.written_sentences(spark, sf)
    return mem.edit_memory(derived.keyed_sentences(s), derived.cache(s), edits(s), F.lit(5000).cast("bigint"))


@query(
    "retranslate_memory",
    """SELECT cache_key, arg_max(source, updated_at) AS source, arg_max(translation, updated_at) AS translation, max(updated_at) AS updated_at FROM (
         SELECT cache_key, source, translation, updated_at FROM cache
         UNION ALL SELECT cache_key, text, '«' || text || '»', 5000 FROM keyed JOIN edits USING (deck_id, page_index, block_index, sent_index)
         WHERE kind NOT IN ('chrome', 'code')) GROUP BY 1""",
    "cache", "keyed", "edits",
)
def retranslate_memory(spark, sf):
    s = stages.written_sentences(spark, sf)
    units, reduced = mem.retranslate(derived.keyed_sentences(s), edits(s), derived.cache(s))
    ask = units.select(*mem.PLACE, F.concat(F.lit("Translate these 1 units:\n[1]"), mem.unit_hint(), F.lit(" "), F.col("text")).alias("prompt"))
    replies = session.written(mem.batch_infer(ask, echo_model).drop("call_error"), "replies")
    answers = mem.parse_reply(replies).where("unit_id = 1")
    return mem.retranslated_memory(units, reduced, answers, F.lit(5000).cast("bigint"))[1]
