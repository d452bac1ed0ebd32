"""SQL views of the derived tables: memory, replies, calls, catalog, glossary, requests."""

from __future__ import annotations

from quire.oracles.base import cache_key, fold, replace, strip, view

view("cache", f"""
SELECT {cache_key('text')} AS cache_key, text AS source,
  CASE WHEN substr(sentence_id, 2, 1) = '0' THEN '' ELSE '«' || text || '»' END AS translation,
  ascii(substr(sentence_id, 2, 1)) + 1000 AS updated_at
FROM (SELECT DISTINCT text, sentence_id FROM sentences WHERE ascii(sentence_id) % 3 = 0)
""", "sentences")

view("keyed", f"SELECT *, {cache_key('text')} AS cache_key FROM sentences", "sentences")

view("translated", """
SELECT k.*, c.translation,
  (k.block_index + k.sent_index + k.page_index) % 10 = 0 AND c.translation IS NOT NULL AS flagged
FROM keyed k LEFT JOIN (SELECT * FROM cache WHERE translation <> '') c USING (cache_key)
""", "keyed", "cache")

view("pending", """
SELECT *, row_number() OVER (PARTITION BY deck_id, page_index ORDER BY block_index, sent_index) AS unit_id
FROM translated WHERE kind NOT IN ('chrome', 'code') AND translation IS NULL
""", "translated")

# What each round answers, straight from the rule the replies are made by.
view("answers", """
SELECT deck_id, page_index, attempt, unit_id,
  CASE WHEN (unit_id + page_index) % 17 = 0 THEN '' WHEN (unit_id + page_index) % 13 = 0 THEN text
       WHEN (unit_id + page_index) % 19 = 0 THEN repeat('x', 4 * length(text) + 61)
       ELSE '«' || text || '»' || attempt END AS answer
FROM pending, (SELECT unnest([0, 1, 2])::BIGINT AS attempt)
WHERE (unit_id + page_index + attempt) % 4 <> 0 AND (unit_id * 7 + page_index) % 23 <> 0
  AND NOT (page_index % 11 = 5 AND attempt = 1) AND NOT (page_index % 29 = 7 AND attempt = 0)
UNION ALL
SELECT DISTINCT deck_id, page_index, attempt, 99999, 'stray'
FROM pending, (SELECT unnest([0, 1, 2])::BIGINT AS attempt)
WHERE NOT (page_index % 11 = 5 AND attempt = 1) AND NOT (page_index % 29 = 7 AND attempt = 0)
""", "pending")

view("reply_errors", """
SELECT DISTINCT deck_id, page_index, attempt FROM pending, (SELECT unnest([0, 1, 2])::BIGINT AS attempt)
WHERE (page_index % 11 = 5 AND attempt = 1) OR (page_index % 29 = 7 AND attempt = 0)
""", "pending")

view("rounds", """
SELECT p.*, f.attempt, f.answer, f.attempt IS NOT NULL AS answered
FROM pending p LEFT JOIN (
  SELECT deck_id, page_index, unit_id, min(attempt) AS attempt, arg_min(answer, attempt) AS answer
  FROM answers a WHERE NOT EXISTS (SELECT 1 FROM reply_errors e
    WHERE e.deck_id = a.deck_id AND e.page_index = a.page_index AND e.attempt <= a.attempt)
  GROUP BY 1, 2, 3) f USING (deck_id, page_index, unit_id)
""", "pending", "answers", "reply_errors")

view("accepted", """
SELECT *, CASE WHEN got THEN t END AS new_translation,
  NOT got OR length(t) > 4 * length(text) + 60
    OR (t = text AND len(string_split(text, ' ')) > 3) AS new_flagged,
  NOT got AS failed
FROM (SELECT *, answered AND t <> '' AS got FROM (SELECT *, coalesce(trim(answer), '') AS t FROM rounds))
""", "rounds")

view("calls", """
SELECT a.conv_id * 1000 + a.turn AS call_id, a.conv_id,
  1704067200 + a.conv_id * 3600 + a.turn * 60 AS epoch,
  make_timestamp((1704067200 + a.conv_id * 3600 + a.turn * 60) * 1000000) AS ts,
  (['deepseek', 'openai', 'moonshot', 'siliconflow', 'ollama', 'siliconflow'])[a.conv_id % 6 + 1] AS provider,
  'm' || (a.conv_id % 6) AS model,
  (['translate', 'ask', 'pricing'])[a.turn % 3 + 1] AS kind,
  coalesce(length(u.text), 0)::BIGINT AS prompt, (coalesce(length(u.text), 0) // 3)::BIGINT AS cached,
  length(a.text)::BIGINT AS completion
FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
WHERE a.role = 'assistant'
""")

view("prices", """
SELECT * FROM (VALUES ('deepseek', 'm0', 2e0, 2e-1, 8e0, 'CNY', 2e0), ('openai', 'm1', 125e-2, 125e-3, 1e1, 'USD', 1e0),
  ('moonshot', 'm2', 4e0, 4e0, 16e0, 'CNY', 1e0), ('siliconflow', 'm5', 1e0, 5e-1, 2e0, 'EUR', 1e0))
  t(provider, model, input, cached_input, output, currency, peak_multiplier)
""")

view("priced_calls", """
SELECT *, priced_if AS priced,
  CASE WHEN priced_if THEN fx * (m * input * greatest(0, prompt - cached) + m * cached_input * cached + m * output * completion) / 1e6 ELSE 0e0 END AS cny,
  CASE WHEN priced_if THEN m * input * fx ELSE 0e0 END AS rate_in,
  CASE WHEN priced_if THEN m * cached_input * fx ELSE 0e0 END AS rate_cached,
  CASE WHEN priced_if THEN m * output * fx ELSE 0e0 END AS rate_out
FROM (SELECT *, CASE WHEN peak THEN peak_multiplier ELSE 1e0 END AS m, input IS NOT NULL AND fx IS NOT NULL AS priced_if
  FROM (SELECT c.*,
    CASE WHEN c.provider = 'ollama' THEN 0e0 ELSE p.input END AS input,
    CASE WHEN c.provider = 'ollama' THEN 0e0 ELSE p.cached_input END AS cached_input,
    CASE WHEN c.provider = 'ollama' THEN 0e0 ELSE p.output END AS output,
    CASE WHEN c.provider = 'ollama' THEN 1e0 ELSE p.peak_multiplier END AS peak_multiplier,
    CASE WHEN c.provider = 'ollama' OR p.currency = 'CNY' THEN 1e0 WHEN p.currency = 'USD' THEN 71e-1 END AS fx,
    isodow(ts + INTERVAL 8 HOUR) <= 5 AND (hour(ts + INTERVAL 8 HOUR) BETWEEN 9 AND 11 OR hour(ts + INTERVAL 8 HOUR) BETWEEN 14 AND 17) AS peak
  FROM calls c LEFT JOIN prices p USING (provider, model)))
""", "calls", "prices")

view("price_feed", """
SELECT lower(p_brand) AS provider, 'm' || (p_partkey % 97) AS model, round(p_retailprice / 1e2, 4) AS input,
  CASE WHEN p_partkey % 3 <> 0 THEN round(p_retailprice / 1e3, 4) END AS cached_input,
  round(p_retailprice / 5e1, 4) AS output, 1704067200 + p_size::BIGINT * 86400 + p_partkey % 1000 AS updated_at,
  'https://' || lower(p_type) || '.example.com' AS source,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS note, p_partkey AS feed_id
FROM part
""")

_BARE = replace(replace(replace("url", r"\A[a-z]+://"), r"[?#].*\z"), r"/+\z")

view("paths", f"""
SELECT page_id, CASE WHEN page_id % 60 = 7 THEN folder || '/.trash' ELSE folder END || '/' ||
  CASE WHEN page_id % 50 = 0 THEN '.' ELSE '' END || name AS path
FROM (SELECT page_id, {replace('bare', r'/[^/]*\z')} AS folder,
        CASE WHEN contains(last, '.') THEN last
             ELSE last || (['.html', '.pdf', '.PPTX', '.md', '.docx', '.zip'])[length(html) % 6 + 1] END AS name
      FROM (SELECT *, string_split(bare, '/')[-1] AS last FROM (SELECT *, {_BARE} AS bare FROM pages)))
""")

view("catalog", r"""
SELECT *, format IN ('docx', 'markdown', 'md', 'pdf', 'ppt', 'pptx') AS readable,
  substr(name, 1, length(name) - CASE WHEN format = '' THEN 0 ELSE length(format) + 1 END) AS stem
FROM (SELECT *, lower(regexp_extract(name, '^.+\.([^.]+)$', 1)) AS format
  FROM (SELECT page_id, path, array_to_string(parts[:-2], '/') AS folder, parts[-1] AS name, len(parts) - 1 AS depth
        FROM (SELECT *, string_split(path, '/') AS parts FROM paths)))
WHERE name NOT LIKE '.%' AND NOT list_contains(string_split(folder, '/'), '.trash') AND path NOT LIKE '.%'
""", "paths")

view("glossary", f"""
SELECT scope, term, arg_min('tr:' || term || ':' || page_id, page_id) AS translation, bool_or(page_id % 11 = 0) AS locked,
  count(*) AS count
FROM (SELECT page_id, array_to_string(list_slice(string_split(folder, '/'), 1, page_id % 3), '/') AS scope,
        unnest(CASE WHEN page_id % 4 = 0 THEN list_transform(w[:-2], lambda x, i: x || ' ' || w[i + 1]) ELSE w END) AS term
      FROM (SELECT page_id, list_filter(string_split_regex({fold("regexp_extract(html, '<title>([^<]*)', 1)")}, '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM pages)
      JOIN catalog USING (page_id))
WHERE term <> '' GROUP BY 1, 2
""", "catalog")

view("chains", """
SELECT folder, i AS scope_depth, array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') AS scope
FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS i FROM (SELECT DISTINCT folder FROM catalog))
""", "catalog")

view("resolved", """
SELECT folder AS leaf, term, arg_max(translation, scope_depth) AS translation, arg_max(locked, scope_depth) AS locked,
  arg_max(count, scope_depth) AS count, arg_max(c.scope, scope_depth) AS scope, arg_max(c.scope, scope_depth) <> folder AS inherited
FROM chains c JOIN glossary g ON g.scope = c.scope GROUP BY folder, term
""", "chains", "glossary")

view("proposals", """
SELECT deck_id, doc_id * 4294967296 + k AS seq, term,
  CASE WHEN (doc_id + k) % 10 = 0 THEN ' ' ELSE ' p:' || doc_id || ':' || k END AS translation
FROM (SELECT doc_id, deck_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS k
      FROM (SELECT doc_id, deck_id, flatten(list_transform(lines, lambda s: string_split(s, ' '))) AS w FROM doc_lines))
""", "doc_lines")

view("deck_homes", r"""
SELECT deck_id, folder FROM (SELECT DISTINCT deck_id FROM docs)
JOIN catalog ON page_id = regexp_extract(deck_id, '(\d+)$', 1)::BIGINT
""", "docs", "catalog")

view("requests", """
SELECT deck_id, page_index, doc_id AS request_id,
  list_transform(range(0, CASE WHEN doc_id % 97 = 0 THEN 30 ELSE doc_id % 4 + 1 END), lambda i: (page_index * 7 + i * 3) % (page_index + 40) - 2) AS picked
FROM docs
""", "docs")

view("ask_pages", """
SELECT r.deck_id, r.page_index, request_id, list_sort(list_distinct(list_append(
  list_sort(list_distinct(list_filter(picked, lambda p: p >= 0 AND p < n_pages))), r.page_index))) AS wanted
FROM requests r JOIN deck_sizes USING (deck_id)
""", "requests", "deck_sizes")
