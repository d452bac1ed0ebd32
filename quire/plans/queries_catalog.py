"""Queries on the library catalog, page text, tolerant JSON and glossaries, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import session
from quire.functions import text as tx
from quire.operators import catalog as cat
from quire.operators import glossary as gl
from quire.operators import memory as mem
from quire.operators import model
from quire.oracles import base as o
from quire.oracles import tables  # noqa: F401 - registers the views
from quire.plans import stages
from quire.plans.queries_memory import pinned_terms
from quire.sources import derived, files
from quire.sources.corpus import json_rows_tolerant, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *needs: str):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = o.with_views(sql, *needs)
        return fn

    return keep


@query("format_support", "SELECT format, readable, count(*) AS items FROM catalog GROUP BY 1, 2", "catalog")
def format_support(spark, sf):
    return cat.format_support(derived.catalog(spark, sf))


@query("path_catalog", "SELECT page_id, path, folder, name, stem, format, depth, readable FROM catalog", "catalog")
def path_catalog(spark, sf):
    rows = derived.catalog(spark, sf).select("page_id", "path", "folder", "name", "stem", "format", "depth", "readable")
    return rows.orderBy(tx.fold_case("folder"), tx.fold_case("name"), "page_id")


o.view("folders", """
SELECT DISTINCT array_to_string(list_slice(string_split(folder, '/'), 1, i), '/') AS path
FROM (SELECT folder, unnest(range(1, len(string_split(folder, '/')) + 1)) AS i FROM catalog)
""", "catalog")


@query(
    "tree_rows",
    f"""SELECT path, is_file, len(parts) - 1 AS depth, array_to_string(list_transform(parts,
          lambda p, i: CASE WHEN is_file AND i = len(parts) THEN '1' ELSE '0' END || {o.fold('p')}), chr(2)) AS sort_key
        FROM (SELECT *, string_split(path, '/') AS parts FROM (
          SELECT path, false AS is_file FROM folders UNION ALL SELECT path, true FROM catalog)) WHERE len(parts) - 1 <= 2""",
    "folders", "catalog",
)
def tree_rows(spark, sf):
    return cat.tree_rows(derived.catalog(spark, sf), 2).orderBy("sort_key", "path")


@query("scope_chain", "SELECT folder, scope_depth, scope FROM chains", "chains")
def scope_chain(spark, sf):
    return cat.scope_chain(derived.catalog(spark, sf).select("folder").distinct())


@query(
    "folder_rollup",
    """SELECT scope, count(*) FILTER (readable) AS readable, count(*) FILTER (NOT readable) AS others
       FROM catalog JOIN chains USING (folder) GROUP BY 1""",
    "catalog", "chains",
)
def folder_rollup(spark, sf):
    return cat.folder_rollup(derived.catalog(spark, sf))


_LANES = [f"sum(('0x' || substr(d, {8 * i + 1}, 8))::BIGINT)::HUGEINT % 4294967296" for i in range(8)]


@query(
    "catalog_signature",
    "SELECT root, items, substr(sha256(items || '-' || " + " || '-' || ".join(f"l{i}" for i in range(8)) + "), 1, 16) AS signature FROM ("
    "SELECT root, count(*) AS items, " + ", ".join(f"{lane} AS l{i}" for i, lane in enumerate(_LANES))
    + " FROM (SELECT string_split(folder, '/')[1] AS root, sha256('f' || chr(10) || path) AS d FROM catalog) GROUP BY 1)",
    "catalog",
)
def catalog_signature(spark, sf):
    return cat.catalog_signature(derived.catalog(spark, sf), F.element_at(F.split("folder", "/"), 1))


#: Levels that the oracle of the hash tree is written out for.
_LEVELS = 12


def _tree_sql() -> str:
    lanes = ", ".join(f"{lane} AS l{i}" for i, lane in enumerate(_LANES))
    digest = "sha256(n || '-' || " + " || '-' || ".join(f"l{i}" for i in range(8)) + ")"
    steps = ["""entries AS (
  SELECT path, false AS dir, true AS ok FROM catalog
  UNION ALL SELECT folder || '/empty' || page_id % 7, true, true FROM catalog WHERE page_id % 13 = 0
  UNION ALL SELECT folder || '/to' || page_id % 5, false, page_id % 2 = 0 FROM catalog WHERE page_id % 17 = 0
), folders AS (
  SELECT DISTINCT array_to_string(list_slice(p, 1, i), '/') AS path FROM (
    SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT CASE WHEN dir THEN string_split(path, '/') ELSE string_split(path, '/')[:-2] END AS p FROM entries))
), nodes AS (
  SELECT path, array_to_string(p[:-2], '/') AS parent, p[-1] AS name, len(p) AS depth, dir, ok FROM (
    SELECT path, string_split(path, '/') AS p, true AS dir, true AS ok FROM folders
    UNION ALL SELECT path, string_split(path, '/'), false, bool_or(ok) FROM entries WHERE NOT dir GROUP BY path)
)"""]
    for depth in range(_LEVELS, -1, -1):
        inner = f" UNION ALL SELECT parent, sha256('d[' || name || chr(10) || h || ']') FROM level{depth + 1}" if depth < _LEVELS else ""
        own = f"(SELECT path, parent, name FROM nodes WHERE dir AND depth = {depth})" if depth else "(SELECT '' AS path, NULL AS parent, '' AS name)"
        steps.append(f"""level{depth} AS (SELECT o.path, o.parent, o.name, coalesce(n, 0) AS children, coalesce(h, sha256('')) AS h FROM {own} o LEFT JOIN (
  SELECT path, n, {digest} AS h FROM (SELECT parent AS path, count(*) AS n, {lanes} FROM (
    SELECT parent, sha256('f:' || name || ':' || ok::INT) AS d FROM nodes WHERE NOT dir AND depth = {depth + 1}{inner}) GROUP BY 1)) s ON s.path = o.path)""")
    every = " UNION ALL ".join(f"SELECT path, children, substr(h, 1, 16) AS signature FROM level{d}" for d in range(_LEVELS + 1))
    return f"SELECT * FROM (WITH {', '.join(steps)} {every})"


@query("tree_signature", _tree_sql(), "catalog")
def tree_signature(spark, sf):
    """The catalog as a hash tree, with some empty folders and some links, half of them broken."""
    c, n = session.written(derived.catalog(spark, sf).select("page_id", "path", "folder"), "catalog"), F.col("page_id")
    entry = lambda name, kind, ok: [F.concat("folder", F.lit(name), *kind[1:]).alias("path"), F.lit(kind[0]).alias("kind"), ok.alias("resolves")]
    entries = (
        c.select("path", F.lit("file").alias("kind"), F.lit(True).alias("resolves"))
        .unionByName(c.where(n % 13 == 0).select(*entry("/empty", ("dir", (n % 7).cast("string")), F.lit(True))))
        .unionByName(c.where(n % 17 == 0).select(*entry("/to", ("link", (n % 5).cast("string")), n % 2 == 0)))
    )
    return cat.tree_signature(cat.library_nodes(entries))


@query(
    "unique_names",
    r"""WITH items AS (SELECT doc_id, lang AS folder, 'w' || (n_chars % 7) || CASE WHEN doc_id % 11 = 0 THEN ' (' || (doc_id % 5 + 1) || ')' ELSE '' END
                        || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '.txt' END AS name FROM documents),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY doc_id) AS n FROM items),
       taken AS (SELECT DISTINCT folder, name FROM items),
       bases AS (SELECT folder, name, max(n) AS top FROM ranked GROUP BY 1, 2),
       numbers AS (SELECT folder, name, unnest(range(2, top + 60)) AS k FROM bases WHERE top > 1),
       made AS (SELECT folder, name, k, regexp_replace(name, '(\.[^.]+)?$', '') || ' (' || k || ')' || regexp_extract(name, '(\.[^.]+)?$') AS made FROM numbers),
       free AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY k) AS r FROM made m
                WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.folder = m.folder AND t.name = m.made))
       SELECT doc_id, i.folder, i.name, CASE WHEN n = 1 THEN i.name ELSE f.made END AS unique_name
       FROM ranked i LEFT JOIN free f ON f.folder = i.folder AND f.name = i.name AND f.r = i.n - 1""",
)
def unique_names(spark, sf):
    n = F.col("doc_id")
    number = F.when(n % 11 == 0, F.concat(F.lit(" ("), (n % 5 + 1).cast("string"), F.lit(")"))).otherwise("")
    name = F.concat(F.lit("w"), (F.col("n_chars") % 7).cast("string"), number, F.when(n % 3 == 0, "").otherwise(".txt"))
    items = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("folder"), name.alias("name"))
    return cat.unique_names(items, "doc_id").select("doc_id", "folder", "name", "unique_name")


_NODES = """SELECT page_id AS id, CASE WHEN page_id % 100 = 98 THEN page_id + 1 WHEN page_id % 100 = 99 THEN page_id - 1
  WHEN page_id > 0 THEN page_id // 3 END AS parent, 'f' || page_id AS name FROM pages"""


@query(
    "hierarchy_paths",
    f"""WITH RECURSIVE nodes AS ({_NODES}), up AS (
          SELECT id, parent, name AS path, [id] AS seen FROM nodes
          UNION ALL SELECT u.id, n.parent, n.name || '/' || u.path, list_append(u.seen, n.id)
          FROM up u JOIN nodes n ON n.id = u.parent WHERE NOT list_contains(u.seen, n.id))
        SELECT id, arg_max(path, len(seen)) AS path, max(len(seen)) AS levels FROM up GROUP BY 1""",
)
def hierarchy_paths(spark, sf):
    n = F.col("page_id")
    parent = (
        F.when(n % 100 == 98, n + 1).when(n % 100 == 99, n - 1).when(n > 0, F.floor(n / 3))
    ).cast("bigint")
    nodes = table(spark, sf, "pages").select(n.alias("id"), parent.alias("parent"), F.concat(F.lit("f"), n.cast("string")).alias("name"))
    return cat.hierarchy_paths(spark, nodes)


@query(
    "import_triage",
    f"""SELECT doc_id, CASE WHEN n_bytes = 0 THEN 'empty file' WHEN n_bytes > 209715200 THEN 'over 200 MB'
          WHEN cleaned = '' THEN 'empty name' WHEN length(cleaned) > 120 THEN 'name too long' END AS reject_reason
        FROM (SELECT doc_id, n_bytes, trim({o.strip('name')}, '. ') AS cleaned FROM (
          SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 0 WHEN doc_id % 29 = 0 THEN n_chars * 4000000 ELSE n_chars END AS n_bytes,
            CASE WHEN doc_id % 31 = 0 THEN ' .. ' ELSE string_split(text, chr(10))[1] END AS name FROM documents))""",
)
def import_triage(spark, sf):
    n = F.col("doc_id")
    items = table(spark, sf, "documents").select(
        "doc_id",
        F.when(n % 23 == 0, 0).when(n % 29 == 0, F.col("n_chars") * 4_000_000).otherwise(F.col("n_chars")).alias("n_bytes"),
        F.when(n % 31 == 0, " .. ").otherwise(F.element_at(F.split("text", "\n"), 1)).alias("name"),
    )
    return cat.import_triage(items).select("doc_id", "reject_reason")


PAGE_JSON = """index bigint, title string, images bigint,
  blocks array<struct<block_index:bigint,kind:string,reason:string,text:string,sentences:array<string>,box:array<double>>>"""


@query(
    "export_nested",
    f"""SELECT deck_id, page_index, coalesce(arg_min(text, block_index) FILTER (kind = 'title'), '') AS title,
          max(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS images, count(*) AS blocks, sum(len(parts))::BIGINT AS sentences,
          sha256(string_agg(concat_ws(chr(31), kind, reason, text, array_to_string(parts, chr(30)),
            round(x * 1e4)::BIGINT, round(y * 1e4)::BIGINT, round(w * 1e4)::BIGINT), chr(29) ORDER BY block_index)) AS digest
        FROM (SELECT *, {o.segment('text')} AS parts FROM rescued) GROUP BY 1, 2""",
    "rescued",
)
def export_nested(spark, sf):
    """Decks written as one JSON document each, pages and blocks and sentences, and read again page by page."""
    block = F.struct(
        "block_index", "kind", "reason", "text", tx.segment("text").alias("sentences"), F.array("x", "y", "w", "h").alias("box")
    )
    c = stages.classified(spark, sf)
    title = F.min_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("block_index")))
    pages = c.groupBy(*model.PAGE).agg(
        F.coalesce(title, F.lit("")).alias("title"), F.max(F.size("page_images")).alias("images"),
        F.array_sort(F.collect_list(block)).alias("blocks"),
    )
    text = F.to_json(F.struct(F.col("page_index").alias("index"), "title", "images", "blocks"))
    folder = session.work_path(spark, "exported")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.export_decks(session.written(pages.select("deck_id", "page_index", text.alias("json")), "pages"), folder, tasks)
    read = files.read_exported(spark, folder, PAGE_JSON)
    box = lambda b, i: F.round(b["box"][i] * 1e4).cast("bigint").cast("string")
    lines = F.transform(
        "page.blocks",
        lambda b: F.concat_ws("\u001f", b["kind"], b["reason"], b["text"], F.array_join(b["sentences"], "\u001e"), box(b, 0), box(b, 1), box(b, 2)),
    )
    return read.select(
        F.col("deck").alias("deck_id"), F.col("page.index").alias("page_index"), "page.title", "page.images",
        F.size("page.blocks").cast("bigint").alias("blocks"),
        F.aggregate("page.blocks", F.lit(0).cast("bigint"), lambda n, b: n + F.size(b["sentences"])).alias("sentences"),
        F.sha2(F.array_join(lines, "\u001d"), 256).alias("digest"),
    )


_HTML = "html"
for _tag in ("script", "style", "nav", "footer"):
    _HTML = o.replace(_HTML, rf"(?is)<{_tag}[^>]*>.*?</{_tag}>", " ")
_HTML = o.collapse(f"replace({o.replace(o.replace(_HTML, '<[^>]+>', ' '), '&nbsp;?', ' ')}, '&amp;', '&')")


@query("html_to_text", f"SELECT page_id, {_HTML} AS text FROM pages")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("text"))


PROPS = T.StructType([T.StructField("k", T.LongType())])


@query(
    "json_rows_tolerant",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0""",
)
def json_rows(spark, sf):
    n = F.col("event_id")
    raw = (
        F.when(n % 17 == 0, F.substring("props", 1, 5)).when(n % 19 == 0, F.replace("props", F.lit('"k"'), F.lit('"other"')))
        .when(n % 23 == 0, F.lit("[1, 2")).otherwise(F.col("props"))
    )
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return json_rows_tolerant(rows, "raw", PROPS, ["k"])


# -- glossaries ---------------------------------------------------------------


def root_glossary(spark, sf):
    return derived.glossary(spark, sf).where("scope = ''").select("term", "translation", "locked", "count")


o.view("seen", f"""
SELECT {o.fold(o.strip('term'))} AS term, arg_min({o.strip('translation')}, seq) AS translation, count(*) AS n
FROM proposals WHERE {o.strip('term')} <> '' AND {o.strip('translation')} <> '' GROUP BY 1
""", "proposals")


@query(
    "glossary_observe",
    """SELECT term, coalesce(g.translation, s.translation) AS translation, coalesce(locked, false) AS locked,
         (coalesce(count, 0) + coalesce(n, 0))::BIGINT AS count
       FROM (SELECT * FROM glossary WHERE scope = '') g FULL JOIN seen s USING (term)""",
    "glossary", "seen",
)
def glossary_observe(spark, sf):
    return gl.observe(root_glossary(spark, sf), derived.proposals(spark, sf))


@query(
    "glossary_lock",
    f"""SELECT term, coalesce(e.translation, g.translation) AS translation, e.translation IS NOT NULL OR coalesce(locked, false) AS locked,
          coalesce(count, 0)::BIGINT AS count
        FROM (SELECT * FROM glossary WHERE scope = '') g FULL JOIN (
          SELECT {o.fold(o.strip('term'))} AS term, arg_max({o.strip('translation')}, seq) AS translation FROM proposals
          WHERE translation <> ' ' GROUP BY 1) e USING (term)""",
    "glossary", "proposals",
)
def glossary_lock(spark, sf):
    edits = derived.proposals(spark, sf).where("translation <> ' '")
    return gl.lock(root_glossary(spark, sf), edits)


@query(
    "glossary_unset",
    "SELECT scope, term, translation FROM glossary WHERE NOT locked",
    "glossary",
)
def glossary_unset(spark, sf):
    g = derived.glossary(spark, sf)
    return gl.unset(g, g.where("locked"), ["scope"]).select("scope", "term", "translation")


@query("glossary_order", "SELECT term, translation, locked, count FROM glossary WHERE scope = ''", "glossary")
def glossary_order(spark, sf):
    return gl.ordered(root_glossary(spark, sf))


@query(
    "prompt_terms",
    """SELECT scope, string_agg(term || ' -> ' || translation, chr(10) ORDER BY rn) AS terms FROM (
         SELECT *, row_number() OVER (PARTITION BY scope ORDER BY locked DESC, count DESC, term) AS rn FROM glossary) GROUP BY 1""",
    "glossary",
)
def prompt_terms(spark, sf):
    return gl.scope_terms(derived.glossary(spark, sf))


def leaves(spark, sf):
    return derived.catalog(spark, sf).select("folder").distinct()


@query("resolve_scoped", "SELECT leaf, term, translation, locked, count, scope, inherited FROM resolved", "resolved")
def resolve_scoped(spark, sf):
    return gl.resolve_scoped(leaves(spark, sf), derived.glossary(spark, sf))


@query(
    "scoped_observe",
    f"""SELECT scope, term, coalesce(g.translation, s.translation) AS translation, coalesce(locked, false) AS locked,
          (coalesce(count, 0) + coalesce(n, 0))::BIGINT AS count
        FROM glossary g FULL JOIN (
          SELECT folder AS scope, {o.fold(o.strip('p.term'))} AS term, arg_min({o.strip('p.translation')}, seq) AS translation, count(*) AS n
          FROM proposals p JOIN deck_homes USING (deck_id)
          LEFT JOIN resolved r ON r.leaf = folder AND r.term = {o.fold(o.strip('p.term'))}
          WHERE r.term IS NULL AND {o.strip('p.term')} <> '' AND {o.strip('p.translation')} <> '' GROUP BY 1, 2) s USING (scope, term)""",
    "glossary", "proposals", "deck_homes", "resolved",
)
def scoped_observe(spark, sf):
    """Homes are one row per deck; they are copied over salts to meet the documents of a huge deck, before
    there is a row for each of their words."""
    from quire.plans import scale

    homes = derived.deck_homes(spark, sf).withColumnRenamed("folder", "leaf")
    g = derived.glossary(spark, sf)
    docs = scale.salted_join(derived.proposing(spark, sf), homes, ["deck_id"], "doc_id", how="inner")
    return gl.scoped_observe(g, derived.proposals_of(docs.select("doc_id", "leaf", "text")))


@query(
    "unset_reveals",
    """SELECT folder AS leaf, term, arg_max(translation, scope_depth) AS translation, arg_max(c.scope, scope_depth) AS scope
       FROM chains c JOIN (SELECT * FROM glossary WHERE NOT (scope <> '' AND locked)) g ON g.scope = c.scope GROUP BY 1, 2""",
    "chains", "glossary",
)
def unset_reveals(spark, sf):
    g = derived.glossary(spark, sf)
    left = gl.unset(g, g.where("scope <> '' AND locked"), ["scope"])
    return gl.resolve_scoped(leaves(spark, sf), left).select("leaf", "term", "translation", "scope")


@query(
    "own_vs_inherited",
    "SELECT leaf, count(*) FILTER (NOT inherited) AS own, count(*) FILTER (inherited) AS inherited FROM resolved GROUP BY 1",
    "resolved",
)
def own_vs_inherited(spark, sf):
    return gl.own_vs_inherited(leaves(spark, sf), derived.glossary(spark, sf))


@query(
    "scope_layers",
    """SELECT g.scope, g.term, any_value(g.translation) AS translation, any_value(g.locked) AS locked, any_value(g.count) AS count,
         arg_max(b.scope, length(b.scope)) AS over_scope, arg_max(b.translation, length(b.scope)) AS over_translation
       FROM glossary g LEFT JOIN glossary b ON b.term = g.term AND b.scope <> g.scope AND (b.scope = '' OR starts_with(g.scope, b.scope || '/'))
       GROUP BY 1, 2""",
    "glossary",
)
def scope_layers(spark, sf):
    g = session.written(derived.glossary(spark, sf), "glossary")
    return gl.scope_layers(g).select("scope", "term", "translation", "locked", "count", "over_scope", "over_translation")


@query(
    "unset_terms",
    """SELECT r.scope, r.term, arg_max(b.scope, length(b.scope)) AS over_scope, arg_max(b.translation, length(b.scope)) AS over_translation
       FROM (SELECT scope, term FROM glossary WHERE scope <> '' AND locked) r
       LEFT JOIN (SELECT * FROM glossary WHERE NOT (scope <> '' AND locked)) b
         ON b.term = r.term AND b.scope <> r.scope AND (b.scope = '' OR starts_with(r.scope, b.scope || '/')) GROUP BY 1, 2""",
    "glossary",
)
def unset_terms(spark, sf):
    """Pinned terms taken out of every folder: what applies there then."""
    g = session.written(derived.glossary(spark, sf), "glossary")
    return gl.revealed(g, g.where("scope <> '' AND locked").select("scope", "term"))


@query(
    "affected_decks",
    """SELECT deck_id, term, n::BIGINT AS sentences
       FROM (SELECT DISTINCT deck_id, term FROM deck_homes JOIN chains USING (folder) JOIN (SELECT scope, term FROM glossary WHERE locked) USING (scope))
       JOIN (SELECT deck_id, term, count(*) AS n FROM term_hits GROUP BY 1, 2) USING (deck_id, term)""",
    "deck_homes", "chains", "glossary", "term_hits",
)
def affected_decks(spark, sf):
    s = stages.sentences(spark, sf)
    hits = mem.term_hits(s, pinned_terms(spark, sf))
    edited = derived.glossary(spark, sf).where("locked").select("scope", "term")
    return gl.affected_decks(derived.deck_homes(spark, sf), edited, hits)
