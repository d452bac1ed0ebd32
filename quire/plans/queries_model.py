"""Queries on identities, block predicates, classification and sentences, with their oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quire import session
from quire.functions import text as tx
from quire.operators import classify as cl
from quire.operators import model
from quire.operators import segmentation as sg
from quire.oracles import base as o
from quire.plans import stages
from quire.sources import files, views
from quire.sources.corpus import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BLOCK = ["deck_id", "page_index", "block_index"]


def query(name: str, sql: str | None = None, *needs: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = o.with_views(sql, *needs)
        return fn

    return keep


@query("scan_corpus", "SELECT source AS deck_id, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def scan_corpus(spark, sf):
    return (
        table(spark, sf, "documents").groupBy(F.col("source").alias("deck_id"), "lang")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))
    )


@query(
    "scan_files",
    f"""SELECT 'd' || doc_id % 16 || '/' || doc_id || '.' || ending AS path, ending AS format,
          CASE WHEN ending <> 'key' THEN length(t) END AS chars, CASE WHEN ending <> 'key' THEN {o.content_id('t')} END AS content_id,
          CASE WHEN ending = 'key' THEN 'unsupported format' END AS error
        FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t,
                CASE WHEN doc_id % 50 = 7 THEN 'key' ELSE (['md', 'txt', 'markdown'])[doc_id % 3 + 1] END AS ending FROM documents)""",
)
def scan_files(spark, sf):
    """The documents laid down as files of several formats, one of them not known, and read by format."""
    n = F.col("doc_id")
    ending = F.when(n % 50 == 7, "key").otherwise(F.element_at(F.array(*map(F.lit, ("md", "txt", "markdown"))), (n % 3 + 1).cast("int")))
    name = F.concat(F.lit("d"), (n % 16).cast("string"), F.lit("/"), n.cast("string"), F.lit("."), ending)
    folder = session.work_path(spark, "decks")
    files.write_decks(table(spark, sf, "documents").select(name.alias("path"), "text"), folder)
    read = files.read_decks(spark, folder)
    return read.select("path", "format", F.length("text").cast("bigint").alias("chars"), tx.content_id("text").alias("content_id"), "error")


@query("content_id", f"SELECT doc_id, {o.content_id('text')} AS content_id FROM documents")
def content_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_id("text").alias("content_id"))


@query(
    "deck_fingerprint",
    "SELECT deck_id, substr(h, 1, 16) AS fingerprint FROM ("
    + reduce(
        lambda inner, _: f"SELECT deck_id, pos >> 10 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM ({inner}) GROUP BY 1, 2",
        range(4),
        "SELECT deck_id, page_index AS pos, sha256(string_agg(text, '' ORDER BY block_index)) AS h FROM blocks GROUP BY 1, 2",
    )
    + ")",
    "blocks",
)
def deck_fingerprint(spark, sf):
    return model.deck_fingerprint(views.blocks(spark, sf))


@query("binary_id", "SELECT page_id, substr(sha256(encode(html)), 1, 16) AS binary_id FROM pages")
def binary_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.binary_id("html").alias("binary_id"))


@query(
    "box_metrics",
    f"SELECT {', '.join(BLOCK)}, round(x + w / 2e0, 9) AS cx, round(y + h / 2e0, 9) AS cy, round(w * h, 9) AS area FROM blocks",
    "blocks",
)
def box_metrics(spark, sf):
    m = model.box_metrics(views.blocks(spark, sf))
    return m.select(*BLOCK, *[F.round(c, 9).alias(c) for c in ("cx", "cy", "area")])


@query(
    "page_aspect",
    """SELECT page_id, round(CASE WHEN width > 0 AND height > 0 THEN width / height ELSE 16e0 / 9e0 END, 6) AS aspect
       FROM (SELECT page_id, (length(html) % 5 * 240)::DOUBLE AS width, (length(url) % 4 * 180)::DOUBLE AS height FROM pages)""",
)
def page_aspect(spark, sf):
    sized = table(spark, sf, "pages").select(
        "page_id",
        (F.length("html") % 5 * 240).cast("double").alias("width"),
        (F.length("url") % 4 * 180).cast("double").alias("height"),
    )
    return model.page_aspect(sized).select("page_id", F.round("aspect", 6).alias("aspect"))


@query(
    "page_title",
    """SELECT deck_id, page_index, coalesce(arg_min(text, block_index) FILTER (kind = 'title'), '') AS title
       FROM rescued GROUP BY 1, 2""",
    "rescued",
)
def page_title(spark, sf):
    return model.page_title(stages.classified(spark, sf)).select("deck_id", "page_index", "title")


@query(
    "flow_partition",
    """SELECT deck_id, page_index, block_index,
         CASE WHEN kind IN ('title', 'body', 'code') THEN 'reading' WHEN kind IN ('caption', 'fragment') THEN 'figure'
              ELSE 'hidden' END AS flow, kind NOT IN ('chrome', 'code') AS translatable FROM rescued""",
    "rescued",
)
def flow_partition(spark, sf):
    return model.flow_partition(stages.classified(spark, sf)).select(*BLOCK, "flow", "translatable")


_FONT_SQL = """SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Mono-Bold' WHEN 1 THEN ' Courier'
  WHEN 2 THEN ' Sans' ELSE '-CMTT10' END AS font FROM part"""


@query(
    "is_monospace",
    "SELECT font, count(*) AS n, bool_or(regexp_matches(lower(font), '" + "|".join(tx.MONOSPACE_MARKERS)
    + f"')) AS mono FROM ({_FONT_SQL}) GROUP BY 1",
)
def is_monospace(spark, sf):
    style = (
        F.when(F.col("p_partkey") % 4 == 0, " Mono-Bold").when(F.col("p_partkey") % 4 == 1, " Courier")
        .when(F.col("p_partkey") % 4 == 2, " Sans").otherwise("-CMTT10")
    )
    fonts = table(spark, sf, "part").select(F.concat("p_name", style).alias("font"))
    return fonts.groupBy("font").agg(F.count(F.lit(1)).alias("n")).withColumn("mono", tx.is_monospace("font"))


_LANG_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.LANGUAGE_NAMES.items())


@query(
    "language_name",
    f"""SELECT tag, count(*) AS docs, CASE WHEN tag = '' OR tag = 'auto' THEN 'the source language'
          ELSE CASE lower(tag) {_LANG_CASES} ELSE tag END END AS name
        FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN '' WHEN 2 THEN upper(lang)
              WHEN 3 THEN lang || '-x' ELSE lang END AS tag FROM documents) GROUP BY 1""",
)
def language_name(spark, sf):
    m = F.col("doc_id") % 5
    tag = (
        F.when(m == 0, "auto").when(m == 1, "").when(m == 2, F.upper("lang"))
        .when(m == 3, F.concat("lang", F.lit("-x"))).otherwise(F.col("lang"))
    )
    tags = table(spark, sf, "documents").select(tag.alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("docs"))
    return tags.withColumn("name", tx.language_name("tag", "the source language"))


@query("collapse_ws", f"SELECT doc_id, {o.collapse('text')} AS text FROM documents")
def collapse_ws(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.collapse_ws("text").alias("text"))


@query(
    "casefold_key",
    f"SELECT {o.fold('text')} AS folded, count(*) AS n FROM conversations GROUP BY 1",
)
def casefold_key(spark, sf):
    turns = table(spark, sf, "conversations").select(tx.fold_case_exact("text").alias("folded"))
    return turns.groupBy("folded").agg(F.count(F.lit(1)).alias("n"))


@query("repetition_index", "SELECT deck_id, rep_text, rep_x, rep_y, pages_seen FROM repeats", "repeats")
def repetition_index(spark, sf):
    return cl.repetition_index(views.blocks(spark, sf))


@query(
    "repeated_furniture",
    f"""SELECT deck_id, page_index, block_index, r.pages_seen, t.n_pages
        FROM blocks b JOIN deck_sizes t USING (deck_id) JOIN repeats r USING (deck_id)
        WHERE r.rep_text = {o.fold(o.strip('b.text'))} AND r.rep_x = round_even(b.x * 20, 0) AND r.rep_y = round_even(b.y * 20, 0)
          AND r.pages_seen >= greatest(3, floor(t.n_pages * 5e-1)) AND length({o.strip('b.text')}) <= 80""",
    "blocks", "deck_sizes", "repeats",
)
def repeated_furniture(spark, sf):
    found = cl.with_furniture(cl.with_features(views.blocks(spark, sf)), views.deck_sizes(spark, sf))
    return found.where("pages_seen IS NOT NULL").select(*BLOCK, "pages_seen", "n_pages")


@query(
    "page_number",
    rf"""SELECT deck_id, page_index, block_index, text FROM blocks
         WHERE regexp_matches({o.strip('text')}, '\A[\p{{Nd}}\s/–—-]{{1,12}}\z') AND (y > 85e-2 OR y < 8e-2)""",
    "blocks",
)
def page_number(spark, sf):
    return cl.with_features(views.blocks(spark, sf)).where(cl.is_page_number()).select(*BLOCK, "text")


@query(
    "structural_kind",
    """SELECT deck_id, page_index, block_index,
         CASE WHEN is_chrome_placeholder THEN 'chrome' ELSE 'title' END AS kind,
         CASE WHEN is_chrome_placeholder THEN 'placeholder:' || placeholder ELSE 'placeholder:title' END AS reason
       FROM blocks WHERE is_chrome_placeholder OR is_title_placeholder""",
    "blocks",
)
def structural_kind(spark, sf):
    b = views.blocks(spark, sf).select(
        *BLOCK, cl.structural_kind().alias("kind"), cl.structural_reason().alias("reason")
    )
    return b.where("kind IS NOT NULL")


@query(
    "verbatim_kind",
    """SELECT deck_id, page_index, block_index, CASE WHEN mono OR math_only THEN 'code' ELSE 'fragment' END AS kind,
         CASE WHEN mono THEN 'monospace font' WHEN math_only THEN 'equation only, no prose' ELSE 'table-cell' END AS reason
       FROM blocks WHERE mono OR math_only OR table_r IS NOT NULL""",
    "blocks",
)
def verbatim_kind(spark, sf):
    b = views.blocks(spark, sf).select(*BLOCK, cl.verbatim_kind().alias("kind"), cl.verbatim_reason().alias("reason"))
    return b.where("kind IS NOT NULL")


@query(
    "title_fallback",
    """SELECT deck_id, page_index, block_index, text FROM (
         SELECT *, cand AND coalesce(sum((is_title_placeholder OR cand)::INT) OVER (PARTITION BY deck_id, page_index
           ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS title
         FROM (SELECT b.*, NOT is_title_placeholder AND NOT is_chrome_placeholder AND y <= 22e-2 AND n_words <= 12
                 AND NOT ends AND font_pt > 0 AND font_pt >= page_font AS cand FROM ruled b)) WHERE title""",
    "ruled",
)
def title_fallback(spark, sf):
    b = cl.with_features(views.blocks(spark, sf)).withColumn("_fixed", cl.structural_kind())
    return cl.title_candidates(b).where("title_fallback").select(*BLOCK, "text")


@query(
    "drawing_label",
    f"""SELECT deck_id, page_index, block_index,
          CASE WHEN {o.words('text')} <= 4 AND NOT {o.ends('text')} THEN 'fragment' ELSE 'caption' END AS kind
        FROM blocks WHERE group_depth > 0""",
    "blocks",
)
def drawing_label(spark, sf):
    b = cl.with_features(views.blocks(spark, sf)).select(*BLOCK, cl.drawing_label().alias("kind"))
    return b.where("kind IS NOT NULL")


@query(
    "figure_caption",
    f"""SELECT deck_id, page_index, block_index, text FROM blocks
        WHERE placeholder = '' AND {o.words('text')} <= 12 AND NOT {o.ends('text')} AND doc_id % 5 = 0
          AND x < 1e0 AND 0e0 < x + w AND y < 3e-1 + 6e-1 AND 3e-1 < y + h""",
    "blocks",
)
def figure_caption(spark, sf):
    return cl.figure_captions(views.blocks(spark, sf), views.images(spark, sf)).select(*BLOCK, "text")


@query("classify", "SELECT deck_id, page_index, block_index, kind, reason FROM classified", "classified")
def classify(spark, sf):
    c = cl.classify(views.blocks(spark, sf), views.deck_sizes(spark, sf))
    return c.select(*BLOCK, "kind", "reason")


@query(
    "rescue_pages",
    "SELECT deck_id, page_index, count(*) AS restored FROM rescued WHERE rescued GROUP BY 1, 2",
    "rescued",
)
def rescue_pages(spark, sf):
    return cl.rescue_warnings(stages.classified(spark, sf)).select("deck_id", "page_index", "restored")


@query("classified_blocks", "SELECT deck_id, page_index, block_index, text, kind, reason, rescued FROM rescued", "rescued")
def classified_blocks(spark, sf):
    return stages.classified(spark, sf).select(*BLOCK, "text", "kind", "reason", "rescued")


@query(
    "kind_histogram",
    "SELECT deck_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("title", "body", "code", "caption", "fragment", "chrome"))
    + ", (SELECT count(*) FROM sentences s WHERE s.deck_id = r.deck_id AND s.kind NOT IN ('chrome', 'code')) AS units"
    " FROM rescued r GROUP BY deck_id",
    "rescued", "sentences",
)
def kind_histogram(spark, sf):
    """Units are counted from the number of sentences per block, so each block is read once."""
    c = stages.classified(spark, sf).withColumn(
        "units", F.when(model.worth_translating(), F.size(tx.segment("text"))).otherwise(0)
    )
    return cl.kind_histogram(c, extra=[F.sum("units").alias("units")])


@query(
    "segment",
    f"SELECT doc_id, len(parts)::BIGINT AS n, array_to_string(parts, chr(10)) AS sentences FROM (SELECT doc_id, {o.segment('text')} AS parts FROM documents)",
)
def segment(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", tx.segment("text").alias("parts"))
    return s.select("doc_id", F.size("parts").cast("bigint").alias("n"), F.array_join("parts", "\n").alias("sentences"))


@query(
    "sentences",
    "SELECT deck_id, page_index, block_index, sent_index, sentence_id, text, kind FROM sentences",
    "sentences",
)
def sentences(spark, sf):
    return stages.sentences(spark, sf).select(*BLOCK, "sent_index", "sentence_id", "text", "kind")


@query(
    "repeated_sentences",
    "SELECT sentence_id, count(*) AS places, count(DISTINCT deck_id) AS decks FROM sentences GROUP BY 1 HAVING count(*) >= 2",
    "sentences",
)
def repeated_sentences(spark, sf):
    return sg.repeated_sentences(sg.sentences(views.blocks(spark, sf).select("deck_id", "text")))
