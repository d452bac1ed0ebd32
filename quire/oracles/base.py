"""Named SQL views for the oracle queries, put together as WITH clauses on demand.

The regular expressions are written for an engine without look-around, so they differ in form
from the ones the operators use.
"""

from __future__ import annotations

from quire.functions.text import ABBREVIATIONS

WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
VIEWS: dict[str, tuple[str, list[str]]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    VIEWS[name] = (sql.strip(), list(needs))


def with_views(select: str, *needs: str) -> str:
    """``select`` preceded by the views it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in VIEWS[name][1]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][0]})" for n in order)
    return f"WITH {parts}\n{select.strip()}"


def replace(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, '{pattern}', '{by}', 'g')"


def strip(c: str) -> str:
    return replace(c, rf"\A{WS}+|{WS}+\z")


def collapse(c: str) -> str:
    return f"trim({replace(c, WS + '+', ' ')})"


def words(c: str) -> str:
    return f"(CASE WHEN {collapse(c)} = '' THEN 0 ELSE len(string_split({collapse(c)}, ' ')) END)"


def first_words(c: str, n: int) -> str:
    plain = f"trim({replace(c, r'[^\p{L}\p{N} ]')})"
    return f"array_to_string(list_slice(string_split_regex({plain}, ' +'), 1, {n}), ' ')"


def short_hash(c: str) -> str:
    return f"substr(sha256({c}), 1, 16)"


def content_id(c: str) -> str:
    return short_hash(strip(c))


def cache_key(text: str, lang: str = "zh-CN", model: str = "m0") -> str:
    return content_id(f"('{model}' || chr(0) || '{lang}' || chr(0) || {text})")


def ends(c: str) -> str:
    return rf"regexp_matches({c}, '[.!?:;]{WS}*\z')"


def fold(c: str) -> str:
    return f"lower(replace({c}, 'ß', 'ss'))"


_C = "[\"''’”)\\]]*"
_W = r"[\p{L}\p{N}_]"
_NW = r"[^\p{L}\p{N}_.]"
_TAIL = rf"\.{_C} "
_ABBREV = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)


def segment(c: str) -> str:
    """List of sentences; the three rules whose matches can touch are applied twice."""
    t = f"regexp_replace({collapse(c)}, '([.!?]{_C} )', '\\1' || chr(1), 'g')"
    for _ in range(2):
        t = replace(t, rf"(?i)(^|{_NW})((?:{_ABBREV})\.*{_TAIL})\x01", r"\1\2")
    for _ in range(2):
        t = replace(t, rf"(^|{_NW})(\p{{L}}{_TAIL})\x01", r"\1\2")
    t = replace(t, rf"(\.{_W}*{_TAIL})\x01", r"\1")
    for _ in range(2):
        t = replace(t, rf"({_TAIL})\x01(\p{{Ll}})", r"\1\2")
    t = replace(t, rf"(^|\x01)(\p{{Nd}}+{_TAIL})\x01", r"\1\2")
    return f"list_filter(list_transform(string_split({t}, chr(1)), lambda p: trim(p)), lambda p: p <> '')"


view("docs", """
SELECT doc_id, text, lang, source AS deck_id,
       row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_index
FROM documents
""")

view("doc_lines", f"""
SELECT *, list_filter(string_split(text, chr(10)), lambda s: {strip('s')} <> '') AS lines FROM docs
""", "docs")

view("blocks_raw", f"""
SELECT deck_id, page_index, doc_id, len(lines) AS n, doc_id % 37 = 0 OR doc_id % 41 = 0 AS bare,
       u.pos - 1 AS block_index, u.b.raw AS raw, u.b.k AS k, u.b.part AS part
FROM (SELECT *, list_concat(
        [{{'raw': deck_id, 'k': -2, 'part': 'header'}}, {{'raw': (page_index + 1)::VARCHAR, 'k': -1, 'part': 'number'}}],
        CASE WHEN len(lines) = 0 THEN [] ELSE list_concat(
          [{{'raw': {first_words('lines[1]', 5)}, 'k': 0, 'part': 'title'}}],
          flatten(list_transform(lines, lambda s, i: list_concat([{{'raw': s, 'k': i::INT, 'part': 'line'}}],
            CASE WHEN (doc_id + i) % 13 = 0 AND i % 2 = 0 THEN [{{'raw': {first_words('s', 3)}, 'k': i::INT, 'part': 'label'}}] ELSE [] END,
            CASE WHEN (doc_id + i) % 19 = 0 THEN [{{'raw': {first_words('s', 8)}, 'k': i::INT, 'part': 'note'}}] ELSE [] END)))) END) AS bs
      FROM doc_lines),
     LATERAL (SELECT unnest(bs) AS b, generate_subscripts(bs, 1) AS pos) u
""", "doc_lines")

view("blocks", """
SELECT deck_id, page_index, doc_id, block_index::BIGINT AS block_index, raw AS text,
  CASE part WHEN 'number' THEN 9e-1 ELSE 8e-2 END AS x,
  CASE part WHEN 'header' THEN 0e0 WHEN 'number' THEN 95e-2 WHEN 'title' THEN 6e-2 ELSE 12e-2 + 8e-1 * (k - 1) / n END AS y,
  CASE part WHEN 'number' THEN 5e-2 ELSE 84e-2 END AS w,
  CASE part WHEN 'header' THEN 2e-2 WHEN 'number' THEN 2e-2 WHEN 'title' THEN 4e-2 ELSE 8e-1 / n END AS h,
  CASE part WHEN 'header' THEN 10e0 WHEN 'number' THEN 10e0 WHEN 'title' THEN 28e0 ELSE 14e0 END AS font_pt,
  part = 'header' AND doc_id % 41 = 0 AS is_chrome_placeholder,
  part = 'title' AND page_index % 3 = 0 AND NOT bare AS is_title_placeholder,
  CASE WHEN part = 'header' AND doc_id % 41 = 0 THEN 'FOOTER'
       WHEN part = 'title' AND page_index % 3 = 0 AND NOT bare THEN 'TITLE' ELSE '' END AS placeholder,
  part = 'line' AND (doc_id + k) % 17 = 0 AS mono,
  part = 'line' AND ((doc_id + k) % 29 = 0 OR (doc_id + k) % 31 = 0) AS has_math,
  part = 'line' AND (doc_id + k) % 29 = 0 AS math_only,
  CASE WHEN cell THEN k // 3 END AS table_r, CASE WHEN cell THEN k % 3 END AS table_c,
  CASE WHEN part = 'line' AND (doc_id + k) % 13 = 0 OR part = 'label' THEN 1 ELSE 0 END AS group_depth,
  CASE WHEN k > 0 THEN 's' || (k // 3)::VARCHAR ELSE 'p' || block_index::VARCHAR END AS shape_id,
  doc_id % 5 = 0 AS has_image
FROM (SELECT *, part = 'line' AND (doc_id + k) % 23 = 0 OR bare AND k >= 0 AS cell FROM blocks_raw)
""", "blocks_raw")

view("repeats", f"""
SELECT deck_id, {fold(strip('text'))} AS rep_text, round_even(x * 20, 0)::BIGINT AS rep_x,
       round_even(y * 20, 0)::BIGINT AS rep_y, count(DISTINCT page_index) AS pages_seen
FROM blocks GROUP BY ALL
""", "blocks")

view("deck_sizes", "SELECT deck_id, max(page_index) + 1 AS n_pages FROM blocks GROUP BY 1", "blocks")

view("ruled", rf"""
SELECT b.*, t.n_pages, r.pages_seen, {words('b.text')} AS n_words, {ends('b.text')} AS ends,
  CASE WHEN is_chrome_placeholder THEN 'chrome'
       WHEN is_title_placeholder THEN 'title'
       WHEN regexp_matches({strip('b.text')}, '\A[\p{{Nd}}\s/–—-]{{1,12}}\z') AND (y > 85e-2 OR y < 8e-2) THEN 'chrome'
       WHEN r.pages_seen >= greatest(3, floor(t.n_pages * 5e-1)) AND length({strip('b.text')}) <= 80 THEN 'chrome'
       WHEN mono OR math_only THEN 'code'
       WHEN table_r IS NOT NULL THEN 'fragment' END AS fixed,
  CASE WHEN is_chrome_placeholder THEN 'placeholder:' || placeholder
       WHEN is_title_placeholder THEN 'placeholder:title'
       WHEN regexp_matches({strip('b.text')}, '\A[\p{{Nd}}\s/–—-]{{1,12}}\z') AND (y > 85e-2 OR y < 8e-2) THEN 'page-number'
       WHEN r.pages_seen >= greatest(3, floor(t.n_pages * 5e-1)) AND length({strip('b.text')}) <= 80
         THEN 'repeats on ' || r.pages_seen || '/' || t.n_pages || ' pages, same position'
       WHEN mono THEN 'monospace font' WHEN math_only THEN 'equation only, no prose'
       WHEN table_r IS NOT NULL THEN 'table-cell' END AS why,
  max(font_pt) OVER (PARTITION BY b.deck_id, page_index) AS page_font
FROM blocks b JOIN deck_sizes t USING (deck_id)
LEFT JOIN repeats r ON r.deck_id = b.deck_id AND r.rep_text = {fold(strip('b.text'))}
  AND r.rep_x = round_even(b.x * 20, 0)::BIGINT AND r.rep_y = round_even(b.y * 20, 0)::BIGINT
""", "blocks", "repeats", "deck_sizes")

view("titled", """
SELECT *, cand AND coalesce(sum((fixed IS NOT DISTINCT FROM 'title' OR cand)::INT) OVER
    (PARTITION BY deck_id, page_index ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
    AS fallback
FROM (SELECT *, fixed IS NULL AND y <= 22e-2 AND n_words <= 12 AND NOT ends AND font_pt > 0 AND font_pt >= page_font AS cand
      FROM ruled)
""", "ruled")

view("figures", """
SELECT *, placeholder = '' AND n_words <= 12 AND NOT ends AND has_image
  AND x < 1e0 AND 0e0 < x + w AND y < 3e-1 + 6e-1 AND 3e-1 < y + h AS on_image
FROM titled
""", "titled")

view("classified", """
SELECT * EXCLUDE (fixed, why, fallback, cand, page_font, on_image, pages_seen),
  CASE WHEN fixed IS NOT NULL THEN fixed WHEN fallback THEN 'title'
       WHEN group_depth > 0 AND n_words <= 4 AND NOT ends THEN 'fragment'
       WHEN group_depth > 0 THEN 'caption' WHEN on_image THEN 'caption' ELSE 'body' END AS kind,
  CASE WHEN fixed IS NOT NULL THEN why WHEN fallback THEN 'top of page, short, largest text'
       WHEN group_depth > 0 AND n_words <= 4 AND NOT ends THEN 'short label inside a grouped drawing'
       WHEN group_depth > 0 THEN 'text inside a grouped drawing'
       WHEN on_image THEN 'short unpunctuated box overlapping a figure' ELSE 'default' END AS reason
FROM figures
""", "figures")

view("rescued", """
SELECT * EXCLUDE (kind, reason, readable, restore), restore AS rescued,
  CASE WHEN restore THEN 'body' ELSE kind END AS kind,
  CASE WHEN restore THEN 'restored: page would otherwise have no content' ELSE reason END AS reason
FROM (SELECT *, readable = 0 AND kind = 'chrome' AND NOT starts_with(reason, 'placeholder:') AS restore
      FROM (SELECT *, max((kind IN ('title', 'body', 'code'))::INT) OVER (PARTITION BY deck_id, page_index) AS readable
            FROM classified))
""", "classified")

view("sentences", f"""
SELECT deck_id, page_index, block_index, doc_id, kind, has_math, u.s AS text, u.i - 1 AS sent_index, {content_id('u.s')} AS sentence_id
FROM (SELECT deck_id, page_index, block_index, doc_id, kind, has_math, {segment('text')} AS parts FROM rescued),
     LATERAL (SELECT unnest(parts) AS s, generate_subscripts(parts, 1) AS i) u
""", "rescued")
