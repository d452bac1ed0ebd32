"""Queries on selections, question contexts and conversations, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import session
from quire.operators import context as ctx
from quire.operators import conversations as conv
from quire.operators import model
from quire.operators import selection as sel
from quire.oracles import base as o
from quire.oracles import tables  # noqa: F401 - registers the views
from quire.plans import stages
from quire.plans.queries_memory import deck_terms
from quire.sources import derived, views
from quire.sources.corpus import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = o.with_views(sql, *needs)
        return fn

    return keep


UNIT_SQL = "deck_id, page_index, block_index, sent_index"

# -- selection ----------------------------------------------------------------

o.view("screen", """
SELECT *, page_index || '|' || block_index || '|' || sent_index AS key,
  row_number() OVER (PARTITION BY deck_id ORDER BY page_index, CASE WHEN kind IN ('title', 'body') THEN 0 ELSE 1 END, block_index, sent_index) - 1 AS position
FROM translated WHERE kind NOT IN ('code', 'chrome')
""", "translated")


@query("screen_order", f"SELECT {UNIT_SQL}, key, position FROM screen", "screen")
def screen_order(spark, sf):
    return screen(spark, sf).select(*sel.UNIT, "key", "position")


def screen(spark, sf):
    """Positions of the selectable sentences; their places are written, not their texts."""
    places = stages.sentences(spark, sf).select(*views.PAGE, "block_index", "sent_index", "kind")
    return sel.screen_order(session.written(places, "places"))


def selection(units):
    """Someone picks three of four sentences over every four pages."""
    chosen = units.where((F.col("block_index") * 3 + F.col("sent_index")) % 4 != 0)
    group = F.concat("deck_id", F.lit(":"), F.shiftright("page_index", 2).cast("string"))
    return chosen.select(group.alias("selection_id"), "deck_id", "key")


o.view("chosen", """
SELECT *, deck_id || ':' || (page_index // 4) AS selection_id FROM screen WHERE (block_index * 3 + sent_index) % 4 <> 0
""", "screen")


@query("select_units", f"SELECT selection_id, {UNIT_SQL}, position FROM chosen", "chosen")
def select_units(spark, sf):
    units = session.written(screen(spark, sf), "units")
    return sel.select_units(units, selection(units)).select("selection_id", *sel.UNIT, "position")


@query(
    "select_range",
    """WITH ends AS (SELECT r.*, a.position AS a, b.position AS b FROM (
           SELECT deck_id, doc_id AS range_id, (page_index + doc_id % 3) || '|3|0' AS from_key,
             CASE WHEN doc_id % 10 = 9 THEN 'nowhere' ELSE page_index || '|4|1' END AS to_key FROM docs) r
         LEFT JOIN screen a ON a.deck_id = r.deck_id AND a.key = r.from_key
         LEFT JOIN screen b ON b.deck_id = r.deck_id AND b.key = r.to_key)
       SELECT range_id, deck_id, to_key AS key FROM ends WHERE a IS NULL OR b IS NULL
       UNION ALL SELECT range_id, e.deck_id, s.key FROM ends e JOIN screen s ON s.deck_id = e.deck_id
         AND s.position BETWEEN least(a, b) AND greatest(a, b) WHERE a IS NOT NULL AND b IS NOT NULL""".replace("WITH ends AS (", "SELECT * FROM (WITH ends AS (", 1) + ")",
    "docs", "screen",
)
def select_range(spark, sf):
    page, doc = F.col("page_index"), F.col("doc_id")
    ranges = views.paged_documents(spark, sf).select(
        "deck_id", doc.alias("range_id"), F.concat((page + doc % 3).cast("string"), F.lit("|3|0")).alias("from_key"),
        F.when(doc % 10 == 9, "nowhere").otherwise(F.concat(page.cast("string"), F.lit("|4|1"))).alias("to_key"),
    )
    return sel.select_range(session.written(screen(spark, sf), "units"), ranges)


@query(
    "copy_text",
    f"""SELECT selection_id, coalesce(string_agg(src, chr(10) || chr(10) ORDER BY para) FILTER (src <> ''), '') AS source,
          coalesce(string_agg(dst, chr(10) || chr(10) ORDER BY para) FILTER (dst <> ''), '') AS target,
          coalesce(string_agg(CASE WHEN dst <> '' THEN src || chr(10) || dst ELSE src END, chr(10) || chr(10) ORDER BY para), '') AS both
        FROM (SELECT selection_id, para, string_agg({o.strip('text')}, ' ' ORDER BY position) AS src,
                coalesce(string_agg({o.strip('translation')}, '' ORDER BY position), '') AS dst
              FROM (SELECT *, sum(fresh) OVER (PARTITION BY selection_id ORDER BY position) AS para FROM (
                SELECT *, CASE WHEN lag(page_index) OVER w = page_index AND lag(block_index) OVER w = block_index
                    AND lag(sent_index) OVER w + 1 = sent_index THEN 0 ELSE 1 END AS fresh
                FROM chosen WINDOW w AS (PARTITION BY selection_id ORDER BY position))) GROUP BY 1, 2) GROUP BY 1""",
    "chosen",
)
def copy_text(spark, sf):
    units = sel.screen_order(session.written(derived.translated(stages.written_sentences(spark, sf)), "translated"))
    group = F.concat("deck_id", F.lit(":"), F.shiftright("page_index", 2).cast("string"))
    chosen = units.where((F.col("block_index") * 3 + F.col("sent_index")) % 4 != 0).withColumn("selection_id", group)
    return sel.copy_text(chosen)


_PARAGRAPHS = f"""SELECT deck_id, min(position) AS position, string_agg({o.strip('text')}, ' ' ORDER BY position) AS src,
    coalesce(string_agg({o.strip('translation')}, '' ORDER BY position) FILTER (coalesce(translation, '') <> ''), '') AS dst
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY deck_id ORDER BY position) AS para FROM (
    SELECT *, CASE WHEN lag(page_index) OVER w = page_index AND lag(block_index) OVER w = block_index
        AND lag(sent_index) OVER w + 1 = sent_index THEN 0 ELSE 1 END AS fresh
    FROM chosen WINDOW w AS (PARTITION BY deck_id ORDER BY position))) GROUP BY deck_id, para"""


@query(
    "copy_parts",
    f"""SELECT deck_id AS selection_id, position // 4096 AS part,
          coalesce(string_agg(src, chr(10) || chr(10) ORDER BY position) FILTER (src <> ''), '') AS source,
          coalesce(string_agg(dst, chr(10) || chr(10) ORDER BY position) FILTER (dst <> ''), '') AS target,
          coalesce(string_agg(CASE WHEN dst <> '' THEN src || chr(10) || dst ELSE src END, chr(10) || chr(10) ORDER BY position), '') AS both
        FROM ({_PARAGRAPHS}) GROUP BY 1, 2""",
    "chosen",
)
def copy_parts(spark, sf):
    """Three of four sentences of each whole deck, copied at once."""
    units = sel.screen_order(session.written(derived.translated(stages.written_sentences(spark, sf)), "translated"))
    chosen = units.where((F.col("block_index") * 3 + F.col("sent_index")) % 4 != 0)
    return sel.copy_parts(chosen.withColumn("selection_id", F.col("deck_id")))


@query(
    "page_ranges",
    """SELECT request_id, string_agg(CASE WHEN a = b THEN (a + 1)::VARCHAR WHEN b = a + 1 THEN (a + 1) || '、' || (b + 1)
           ELSE (a + 1) || '–' || (b + 1) END, '、' ORDER BY a) AS ranges
       FROM (SELECT request_id, min(p) AS a, max(p) AS b FROM (
         SELECT request_id, p, p - row_number() OVER (PARTITION BY request_id ORDER BY p) AS island
         FROM (SELECT request_id, unnest(wanted) AS p FROM ask_pages)) GROUP BY request_id, island) GROUP BY 1""",
    "ask_pages",
)
def page_ranges(spark, sf):
    return wanted(spark, sf).select("request_id", sel.page_ranges("wanted").alias("ranges"))


@query(
    "shape_groups",
    """SELECT deck_id, page_index, group_index, min(shape_id) AS shape, min(block_index) AS first_block, count(*) AS blocks
       FROM (SELECT *, sum(fresh) OVER (PARTITION BY deck_id, page_index ORDER BY block_index)::BIGINT AS group_index FROM (
         SELECT *, CASE WHEN lag(shape_id) OVER (PARTITION BY deck_id, page_index ORDER BY block_index) = shape_id THEN 0 ELSE 1 END AS fresh FROM blocks))
       GROUP BY 1, 2, 3""",
    "blocks",
)
def shape_groups(spark, sf):
    return sel.shape_groups(views.blocks(spark, sf)).select("deck_id", "page_index", "group_index", "shape", "first_block", "blocks")


# -- question context -----------------------------------------------------------


def wanted(spark, sf):
    return ctx.ask_pages(derived.requests(spark, sf), views.deck_sizes(spark, sf))


@query("ask_pages", "SELECT request_id, array_to_string(wanted, ',') AS wanted FROM ask_pages", "ask_pages")
def ask_pages(spark, sf):
    return wanted(spark, sf).select("request_id", F.array_join(F.col("wanted").cast("array<string>"), ",").alias("wanted"))


o.view("picks", """
SELECT doc_id AS request_id, deck_id, block_index * 100000 + sent_index AS seq, sentence_id FROM sentences
WHERE kind IN ('title', 'body') AND (block_index * 5 + sent_index) % 7 = 0
UNION ALL SELECT doc_id, deck_id, -1, 'unknown' FROM docs WHERE page_index % 4 = 0
""", "sentences", "docs")

o.view("selected", """
SELECT request_id, p.deck_id, seq, p.sentence_id, page_index, block_index, sent_index, text, translation,
  row_number() OVER (PARTITION BY request_id ORDER BY seq) AS n
FROM picks p JOIN (SELECT * FROM translated WHERE kind NOT IN ('chrome', 'code')
  QUALIFY row_number() OVER (PARTITION BY deck_id, sentence_id ORDER BY page_index, block_index, sent_index) = 1) s
  ON s.deck_id = p.deck_id AND s.sentence_id = p.sentence_id
""", "picks", "translated")


def picks(spark, sf, sentences):
    chosen = sentences.where(F.col("kind").isin("title", "body") & ((F.col("block_index") * 5 + F.col("sent_index")) % 7 == 0))
    known = chosen.select(
        F.col("doc_id").alias("request_id"), "deck_id", (F.col("block_index") * 100_000 + F.col("sent_index")).alias("seq"), "sentence_id"
    )
    odd = views.paged_documents(spark, sf).where("page_index % 4 = 0").select(
        F.col("doc_id").alias("request_id"), "deck_id", F.lit(-1).cast("bigint").alias("seq"), F.lit("unknown").alias("sentence_id")
    )
    return known.unionByName(odd)


@query("selected_sentences", "SELECT request_id, n, sentence_id, page_index, block_index, sent_index, translation FROM selected", "selected")
def selected_sentences(spark, sf):
    s = session.written(derived.translated(stages.written_sentences(spark, sf)), "translated")
    found = ctx.selected_sentences(picks(spark, sf, s), s)
    return found.select("request_id", "n", "sentence_id", "page_index", "block_index", "sent_index", "translation")


o.view("page_lines", """
SELECT deck_id, page_index, string_agg(line, chr(10) ORDER BY block_index, sent_index) AS lines FROM (
  SELECT deck_id, page_index, block_index, sent_index, CASE WHEN kind = 'title' THEN '# ' ELSE '- ' END || text
    || coalesce(chr(10) || '    ' || translation, '') AS line FROM translated WHERE kind NOT IN ('chrome', 'code')
  UNION ALL SELECT deck_id, page_index, block_index, 0, '- ' || text FROM rescued WHERE kind = 'code') GROUP BY 1, 2
""", "translated", "rescued")

o.view("titles", """
SELECT deck_id, page_index, coalesce(arg_min(text, block_index) FILTER (kind = 'title'), '') AS title FROM rescued GROUP BY 1, 2
""", "rescued")

o.view("ask_terms", """
SELECT deck_id, string_agg(term || ' -> ' || translation, chr(10) ORDER BY rn) AS terms FROM (
  SELECT deck_id, term, translation, row_number() OVER (PARTITION BY deck_id ORDER BY locked DESC, inherited, count DESC, term) AS rn
  FROM deck_homes JOIN resolved ON leaf = folder) WHERE rn <= 30 GROUP BY 1
""", "deck_homes", "resolved")


@query(
    "bilingual_context",
    """SELECT request_id, 'Deck: ' || deck_id || chr(10) || 'Slide ' || (page_index + 1) || ' of ' || n_pages
         || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END || chr(10)
         || CASE WHEN n > 1 THEN 'The student chose slides ' || listed || ' as the context for this question; they are reading slide ' || (page_index + 1) || '.' || chr(10) ELSE '' END
         || chr(10) || body || coalesce(chr(10) || selection, '')
         || coalesce(chr(10) || chr(10) || 'Terminology established in this course:' || chr(10) || terms, '') AS context
       FROM (SELECT request_id, deck_id, page_index, n_pages, n, listed, string_agg(
               CASE WHEN n > 1 THEN '--- Slide ' || (p + 1) || CASE WHEN ptitle <> '' THEN ' — ' || ptitle ELSE '' END
                 || CASE WHEN p = page_index THEN ' (the slide being read)' ELSE '' END || ' ---'
                 ELSE 'The full slide, with the translation shown to the student:' END
               || coalesce(chr(10) || lines, '') || chr(10), chr(10) ORDER BY p) AS body
             FROM (SELECT a.*, n_pages, len(wanted) AS n, array_to_string(list_transform(wanted, lambda w: w + 1), ', ') AS listed, unnest(wanted) AS p
                   FROM ask_pages a JOIN deck_sizes USING (deck_id)) q
             JOIN (SELECT deck_id, page_index AS p, title AS ptitle FROM titles) USING (deck_id, p)
             LEFT JOIN (SELECT deck_id, page_index AS p, lines FROM page_lines) USING (deck_id, p)
             GROUP BY 1, 2, 3, 4, 5, 6)
       JOIN titles USING (deck_id, page_index) LEFT JOIN ask_terms USING (deck_id)
       LEFT JOIN (SELECT request_id, CASE WHEN count(*) = 1 THEN 'The student selected this sentence:'
                    ELSE 'The student selected these ' || count(*) || ' sentences:' END || chr(10) || string_agg(
                    CASE WHEN total > 1 THEN '  ' || n || '. ' ELSE '  ' END || text
                    || coalesce(chr(10) || '     (shown to them as: ' || translation || ')', ''), chr(10) ORDER BY n) AS selection
                  FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS total FROM selected) GROUP BY 1) USING (request_id)""",
    "ask_pages", "deck_sizes", "titles", "page_lines", "ask_terms", "selected",
)
def bilingual_context(spark, sf):
    c = stages.written_blocks(spark, sf)
    titles = session.written(model.page_title(c), "titles")
    code = session.written(c.where("kind = 'code'"), "code")
    s = session.written(stages.sentences_of(c).drop("has_math", "shard"), "sentences")
    session.forgotten(c)  # each table goes once nothing reads it; they would add up to several times the input
    places = session.written(ctx.selected_places(picks(spark, sf, s), s), "places")
    translations = session.written(derived.translations(s), "translations")
    pages = ctx.context_pages(titles, code, s, translations, places.select(*sel.UNIT).distinct())
    pages = session.written_by_key(ctx.packed(pages, "lines"), "pages", "deck_id", "page_index")
    for done in (titles, code, s, translations):
        session.forgotten(done)
    chosen = ctx.selection_text(ctx.selected_texts(places, pages))
    terms = session.written(deck_terms(spark, sf, 30), "terms")
    return ctx.bilingual_context(wanted(spark, sf), pages, chosen, terms)


def frames(spark, sf):
    """Assistant turns as they arrive over a stream: one frame per word, with noise around."""
    said = table(spark, sf, "conversations").where("role = 'assistant'")
    pieces = F.split("text", " ")

    def frame(piece, i):
        content = F.when(i == 0, piece).otherwise(F.concat(F.lit(" "), piece))
        delta = F.struct(F.struct(content.alias("content")).alias("delta"))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(delta).alias("choices"))))

    usage = F.concat(
        F.lit('data: {"choices":[],"usage":{"prompt_tokens":'), F.col("turn").cast("string"),
        F.lit(',"completion_tokens":'), F.length("text").cast("string"), F.lit("}}"),
    )
    lines = F.concat(
        F.array(F.lit(": keep-alive")), F.transform(pieces, frame),
        F.array(F.lit("data: {broken"), F.lit("event: ping"), usage, F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')),
    )
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.posexplode(lines).alias("seq", "line"))


@query(
    "assemble_fragments",
    "SELECT conv_id * 1000 + turn AS message_id, text, turn AS prompt_tokens, length(text) AS completion_tokens FROM conversations WHERE role = 'assistant'",
)
def assemble_fragments(spark, sf):
    return ctx.assemble_fragments(frames(spark, sf))


@query(
    "chat_requests",
    """SELECT conv_id, 0 AS position, 'system' AS role, 'Answer briefly.' AS content FROM (SELECT DISTINCT conv_id FROM conversations)
       UNION ALL SELECT conv_id, 1, 'user', 'Context of ' || conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
       UNION ALL SELECT conv_id, 2, 'assistant', 'Understood. What is your question?' FROM (SELECT DISTINCT conv_id FROM conversations)
       UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 2,
         CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'user' ELSE role END, text FROM conversations""",
)
def chat_requests(spark, sf):
    about = F.concat(F.lit("Context of "), F.col("conv_id").cast("string"))
    return ctx.chat_requests(table(spark, sf, "conversations"), F.lit("Answer briefly."), about)


# -- conversations --------------------------------------------------------------


def timed_turns(spark, sf):
    at = F.lit(derived.EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return table(spark, sf, "conversations").withColumn("at", at)


_TITLE = f"coalesce(arg_min({o.strip('text')}, turn) FILTER (role = 'user' AND {o.strip('text')} <> ''), '新对话')"


@query(
    "chat_summaries",
    f"""SELECT conv_id, {_TITLE} AS title, min(1704067200 + conv_id * 3600 + turn * 60) AS created,
          max(1704067200 + conv_id * 3600 + turn * 60) AS updated, count(*) AS count FROM conversations GROUP BY 1""",
)
def chat_summaries(spark, sf):
    return conv.summaries(timed_turns(spark, sf)).orderBy(F.col("updated").desc(), "conv_id")


@query("chat_titles", f"SELECT conv_id, {_TITLE} AS title FROM conversations GROUP BY 1")
def chat_titles(spark, sf):
    return conv.titles(table(spark, sf, "conversations"))


@query(
    "chat_append",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY fresh, turn) - 1 AS turn, role, text FROM (
         SELECT conv_id, turn, role, text, 0 AS fresh FROM conversations
         UNION ALL SELECT CASE WHEN conv_id % 5 = 0 THEN conv_id + 1000000 ELSE conv_id END, turn, role, 'again: ' || text, 1
         FROM conversations WHERE role = 'user')""",
)
def chat_append(spark, sf):
    turns = table(spark, sf, "conversations")
    to = F.when(F.col("conv_id") % 5 == 0, F.col("conv_id") + 1_000_000).otherwise(F.col("conv_id"))
    fresh = turns.where("role = 'user'").select(to.alias("conv_id"), "turn", "role", F.concat(F.lit("again: "), "text").alias("text"))
    return conv.append(turns, fresh)


@query(
    "chat_edit",
    f"""SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN title WHEN conv_id % 9 = 0 THEN '新对话'
          ELSE {o.strip("'  Renamed ' || conv_id || ': ' || title || ' ' || title")} END AS title
        FROM (SELECT conv_id, {_TITLE} AS title FROM conversations GROUP BY 1) WHERE conv_id % 10 <> 4""",
)
def chat_edit(spark, sf):
    titles = conv.titles(table(spark, sf, "conversations"))
    wording = F.concat(F.lit("  Renamed "), F.col("conv_id").cast("string"), F.lit(": "), "title", F.lit(" "), "title")
    renames = titles.where("conv_id % 3 = 0").select(
        "conv_id", F.when(F.col("conv_id") % 9 == 0, "  ").otherwise(wording).alias("new_title")
    )
    return conv.edit(titles, renames, titles.where("conv_id % 10 = 4"))


@query(
    "message_text",
    f"""SELECT conv_id, turn, {o.strip("coalesce(string_agg(line, ' ' ORDER BY i) FILTER (i % 3 <> 2), '')")} AS text FROM (
          SELECT conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
          FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM conversations)) GROUP BY 1, 2""",
)
def message_text(spark, sf):
    def part(line, i):
        return F.struct(F.when(i % 3 == 1, "image").otherwise("text").alias("type"), line.alias("text"))

    nested = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.split("text", "\n"), part).alias("content"))
    return nested.select("conv_id", "turn", conv.message_text("content").alias("text"))
