from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as cat
from quire.operators import glossary as gl

G = "scope string, term string, translation string, locked boolean, count bigint"


def test_observe_keeps_the_first_rendering_and_pinned_terms(spark):
    now = spark.createDataFrame([("key", "Schlüssel", True, 2)], "term string, translation string, locked boolean, count bigint")
    seen = spark.createDataFrame([(3, " Key ", "Taste"), (2, "row", "Zeile 2"), (1, "Row", "Zeile"), (4, "blank", "  "), (5, " ", "x")], "seq int, term string, translation string")
    got = {r.term: (r.translation, r.locked, r["count"]) for r in gl.observe(now, seen).collect()}
    assert got == {"key": ("Schlüssel", True, 3), "row": ("Zeile", False, 2)}


def test_lock_carries_the_count(spark):
    now = spark.createDataFrame([("key", "Taste", False, 4)], "term string, translation string, locked boolean, count bigint")
    edits = spark.createDataFrame([(1, "KEY", "a"), (2, "key", " Schlüssel "), (1, "new", "neu")], "seq int, term string, translation string")
    got = {r.term: (r.translation, r.locked, r["count"]) for r in gl.lock(now, edits).collect()}
    assert got == {"key": ("Schlüssel", True, 4), "new": ("neu", True, 0)}


def test_the_narrower_scope_wins_and_unset_reveals(spark):
    g = spark.createDataFrame([("", "set", "Menge", True, 1), ("", "key", "Taste", False, 5), ("s1/db", "key", "Schlüssel", False, 1), ("s2", "key", "nein", True, 1)], G)
    leaves = spark.createDataFrame([("s1/db",)], "folder string")
    got = {r.term: (r.translation, r.scope, r.inherited) for r in gl.resolve_scoped(leaves, g).collect()}
    assert got == {"set": ("Menge", "", True), "key": ("Schlüssel", "s1/db", False)}
    order = gl.resolve_scoped(leaves, g).orderBy(*gl.resolved_order())
    assert [r.term for r in order.collect()] == ["set", "key"]
    gone = gl.unset(g, spark.createDataFrame([("s1/db", "Key")], "scope string, term string"), ["scope"])
    assert {r.term: r.translation for r in gl.resolve_scoped(leaves, gone).collect()}["key"] == "Taste"


def test_scoped_observe_does_not_shadow_what_applies(spark):
    g = spark.createDataFrame([("", "key", "Schlüssel", True, 1)], G)
    seen = spark.createDataFrame([("a/b", 1, "Key", "Taste"), ("a/b", 2, "row", "Zeile")], "leaf string, seq int, term string, translation string")
    got = {(r.scope, r.term): (r.translation, r["count"]) for r in gl.scoped_observe(g, seen).collect()}
    assert got == {("", "key"): ("Schlüssel", 1), ("a/b", "row"): ("Zeile", 1)}


def random_scopes(seed):
    rng = random.Random(seed)
    scopes = sorted({"/".join(rng.choice("abc") for _ in range(rng.randrange(5))) for _ in range(40)} | {"", "a b", "a-b/c", "a"})
    terms = {(rng.choice(scopes), rng.choice("tuvwxyz")) for _ in range(60)}
    return scopes, [(s, t, f"{s}:{t}", False, 1) for s, t in sorted(terms)]


@pytest.mark.parametrize("seed", range(2))
def test_layers_counts_and_what_removal_reveals_equal_the_resolved_lists(spark, seed):
    scopes, terms = random_scopes(seed)
    g, leaves = spark.createDataFrame(terms, G), spark.createDataFrame([(s,) for s in scopes], "folder string")
    resolved = gl.resolve_scoped(leaves, g).collect()
    want = {s: [0, 0] for s in scopes}
    for r in resolved:
        want[r.leaf][r.inherited] += 1
    got = {r.scope: [r.own, r.inherited] for r in gl.scope_counts(leaves.withColumnRenamed("folder", "scope"), g).collect()}
    assert got == want
    assert {r.leaf: [r.own, r.inherited] for r in gl.own_vs_inherited(leaves, g).collect()} == {s: n for s, n in want.items() if sum(n)}
    layers = gl.scope_layers(g)
    assert layers.count() == len(terms)  # as many rows as terms, however many scopes inherit them
    for r in layers.collect():
        above = [s for s, t, *_ in terms if t == r.term and s != r.scope and (s == "" or r.scope.startswith(s + "/"))]
        assert r.over_scope == (max(above, key=lambda s: len(s.split("/")) if s else 0) if above else None), r
    removed = [(s, t.upper()) for s, t, *_ in terms[::3]]
    after = gl.revealed(g, spark.createDataFrame(removed, "scope string, term string")).collect()
    left = gl.unset(g, spark.createDataFrame(removed, "scope string, term string"), ["scope"])
    applies = {(r.leaf, r.term): (r.scope, r.translation) for r in gl.resolve_scoped(leaves, left).collect()}
    assert {(r.scope, r.term): (r.over_scope, r.over_translation) for r in after} == {(s, t.lower()): applies.get((s, t.lower()), (None, None)) for s, t in removed}


def test_the_tour_numbers_every_scope_inside_its_folder(spark):
    scopes, _ = random_scopes(5)
    tree = {r.scope: (r.enter, r.leave) for r in gl.scope_tree(spark.createDataFrame([(s,) for s in scopes], "scope string")).collect()}
    assert sorted(e for e, _ in tree.values()) == [*range(len(tree))] and set(scopes) <= set(tree)
    for a, (enter, leave) in tree.items():
        assert {s for s, (e, _) in tree.items() if enter <= e <= leave} == {s for s in tree if s == a or a == "" or s.startswith(a + "/")}


def test_terms_of_the_root_cost_nothing_in_the_scopes_below(spark):
    """Half of all scopes and all terms hang on the root: the work is terms and scopes, not their product."""
    leaves = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 1500).cast("string"), F.lit("/g"), F.col("id").cast("string")).alias("scope"))
    g = spark.range(2000).select(F.lit("").alias("scope"), F.concat(F.lit("t"), "id").alias("term"), F.lit("x").alias("translation"), F.lit(False).alias("locked"), F.lit(1).alias("count"))
    got = gl.scope_counts(leaves, g)
    assert got.count() == 3000 and got.where("own <> 0 OR inherited <> 2000").count() == 0


def paths(spark, names):
    return cat.path_catalog(spark.createDataFrame([(n,) for n in names], "path string"))


def test_names_are_split_as_a_path_library_does(spark):
    got = {r.path: (r.folder, r.stem, r.format, r.readable) for r in paths(spark, ["a/b.tar.GZ", "a/x.PPTX", "a/noend", "a/end.", "a/.hidden", "a/.trash/y.md", "top.md", ".git/z.md"]).collect()}
    assert got == {
        "a/b.tar.GZ": ("a", "b.tar", "gz", False), "a/x.PPTX": ("a", "x", "pptx", True), "a/noend": ("a", "noend", "", False),
        "a/end.": ("a", "end.", "", False), "top.md": ("", "top", "md", True),
    }


def test_chain_tree_and_rollup(spark):
    c = paths(spark, ["s1/db/l1.pdf", "s1/db/notes.zip", "s1/a.md", "s2/x.md"])
    assert spark.range(1).select(cat.chain(F.lit("a/b/c")).alias("c")).first().c == ["", "a", "a/b", "a/b/c"]
    assert spark.range(1).select(cat.chain(F.lit("")).alias("c")).first().c == [""]
    rows = [r.path for r in cat.tree_rows(c, 5).orderBy("sort_key").collect()]
    assert rows == ["s1", "s1/db", "s1/db/l1.pdf", "s1/db/notes.zip", "s1/a.md", "s2", "s2/x.md"]
    assert [r.path for r in cat.tree_rows(c, 1).orderBy("sort_key").collect()] == ["s1", "s1/db", "s1/a.md", "s2", "s2/x.md"]
    assert {r.scope: (r.readable, r.others) for r in cat.folder_rollup(c).collect()} == {"": (3, 1), "s1": (2, 1), "s1/db": (1, 1), "s2": (1, 0)}


def test_signature_changes_when_an_item_moves_and_only_then(spark):
    def sig(names):
        return cat.catalog_signature(paths(spark, names), F.lit("r")).first().signature

    base = sig(["r/a/x.md", "r/b/y.md"])
    assert base == sig(["r/b/y.md", "r/a/x.md"])
    assert len({base, sig(["r/b/x.md", "r/b/y.md"]), sig(["r/a/x.md"]), sig(["r/a/x.md", "r/b/z.md"])}) == 4


def brute_unique(names):
    own = set(names)
    used, seen, out = set(), {}, []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        if seen[n] == 1:
            out.append(n)
            continue
        m = re.match(r"\A(.+)(\.[^.]+)\Z", n)
        stem, ext = (m.group(1), m.group(2)) if m else (n, "")
        k = 2
        while f"{stem} ({k}){ext}" in own or f"{stem} ({k}){ext}" in used:
            k += 1
        used.add(f"{stem} ({k}){ext}")
        out.append(f"{stem} ({k}){ext}")
    return out


def test_unique_names_against_one_at_a_time(spark):
    names = [["a.txt", "a (2).txt", "a (4).txt", "b", "a (2) (2).txt", "b (3)"][(i * i + i // 3) % 6] for i in range(400)]
    items = spark.createDataFrame([(i, "f", n) for i, n in enumerate(names)], "id bigint, folder string, name string")
    got = [r.unique_name for r in cat.unique_names(items, "id").orderBy("id").collect()]
    assert got == brute_unique(names)
    assert len(set(got)) == len(got)


def test_hierarchy_with_cycle_and_missing_parent(spark):
    nodes = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "x"), (5, 4, "y"), (6, 99, "lost"), (7, 7, "self")], "id int, parent int, name string")
    got = {r.id: r.path for r in cat.hierarchy_paths(spark, nodes).collect()}
    assert got == {1: "a", 2: "a/b", 3: "a/b/c", 4: "y/x", 5: "x/y", 6: "lost", 7: "self"}


def test_triage_keeps_every_item(spark):
    items = spark.createDataFrame([("ok.md", 5), ("e.md", 0), ("big.md", 300 * 1024 * 1024), (" . ", 3), ("n" * 130, 3)], "name string, n_bytes bigint")
    good, bad = cat.split_triage(cat.import_triage(items))
    assert [r.name for r in good.collect()] == ["ok.md"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["empty file", "empty name", "name too long", "over 200 MB"]


def signed(spark, *entries):
    rows = [(p.rstrip("/"), "dir" if p.endswith("/") else "file", True) if isinstance(p, str) else p for p in entries]
    nodes = cat.library_nodes(spark.createDataFrame(rows, "path string, kind string, resolves boolean"))
    return {r.path: (r.children, r.signature) for r in cat.tree_signature(nodes).collect()}


def test_the_tree_changes_with_folders_decks_and_links_and_with_nothing_else(spark):
    root = lambda *e: signed(spark, *e)[""][1]
    start = root("y/")
    assert root("y/", "z/") != start  # an empty folder comes
    with_deck = root("y/Lec01.pptx")
    assert with_deck != start and root("y/Lec01.pptx", "y/db/") != with_deck  # a deck, then a folder inside
    assert root("a/Lec01.pptx", "b/") != root("a/", "b/Lec01.pptx")  # moved: the same names
    assert root("y/", "y/.DS_Store", ".meta/x.db", "y/.trash/old.md") == start  # nothing that is shown
    broken, mended = root("y/", ("y/deck.pdf", "link", False)), root("y/", ("y/deck.pdf", "link", True))
    assert len({start, broken, mended}) == 3 and mended == root("y/deck.pdf")
    assert signed(spark) == {"": (0, signed(spark)[""][1])}


def test_equal_folders_have_equal_values_and_order_does_not_matter(spark):
    rng = random.Random(2)
    names = [f"{f}/{s}/{n}.md" for f in ("one", "two") for s in "ab" for n in range(20)] + ["one/c/", "two/c/"]
    first = signed(spark, *names)
    rng.shuffle(names)
    assert signed(spark, *names) == first and first["one"] == first["two"] and first["one/a"][0] == 20
    assert first["one/c"][0] == 0 and signed(spark, *names, "two/b/x.md")["one"] == first["one"]


def test_one_folder_with_a_third_of_all_names(spark):
    n = F.col("id")
    path = F.when(n % 3 == 0, F.concat(F.lit("hot/"), n.cast("string"))).otherwise(F.concat(F.lit("f"), (n % 500).cast("string"), F.lit("/"), n.cast("string")))
    entries = spark.range(30_000).select(path.alias("path"), F.lit("file").alias("kind"), F.lit(True).alias("resolves"))
    got = {r.path: r.children for r in cat.tree_signature(cat.library_nodes(entries)).where("path IN ('', 'hot')").collect()}
    assert got["hot"] == 10_000


def test_words_are_exploded_and_folded_once(spark):
    """No filter works out the words of a document, or the key of a term, only to see whether they are blank."""
    from quire.sources import derived

    offered = derived.proposals(spark, "/root/testdata/sf0.001")
    for df in (offered, gl.worded(offered)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        worked = [line for line in plan.splitlines() if "Filter " in line and ("split(" in line or "trim(" in line)]
        assert not worked, worked


def test_proposals_are_counted_before_they_are_looked_up(spark):
    """What applies in a folder is looked up for a row a term, not for each time it was proposed."""
    now = spark.createDataFrame([("a", "key", "K", False, 1)], "scope string, term string, translation string, locked boolean, count long")
    seen = spark.createDataFrame(
        [("a/b", i, t, f"{t}{i}") for i in range(50) for t in ("Key", " new ", " ")], "leaf string, seq long, term string, translation string"
    )
    got = gl.scoped_observe(now, seen)
    assert {(r.scope, r.term): (r.translation, r["count"]) for r in got.collect()} == {("a", "key"): ("K", 1), ("a/b", "new"): ("new 0", 50)}
    joined = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "min_by" in line]
    assert not joined, joined  # counted and written before the plan of the look-up
