"""Paths as a library: formats, folders, scopes, counts, signatures, names."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import session
from quire.functions import text as tx
from quire.plans import scale
from quire.sources.corpus import READABLE_FORMATS

# Folder names that are never shown.
RESERVED = (".trash", ".meta")
# Limits on what can be imported.
MAX_BYTES = 200 * 1024 * 1024
MAX_NAME = 120


def path_catalog(paths: DataFrame) -> DataFrame:
    """Split ``path`` into folder, stem, format and depth; hidden and reserved names are left out."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    split = paths.withColumn("folder", F.array_join(folders, "/")).withColumn("name", F.element_at(parts, -1))
    hidden = (
        F.col("name").startswith(".") | F.exists(folders, lambda f: f.isin(*RESERVED))
        | F.get(parts, F.lit(0)).startswith(".")
    )
    # The ending starts at the last dot that has something on both sides.
    ending = F.regexp_extract("name", r"\A.+(\.[^.]+)\z", 1)
    return (
        split.where(~hidden)
        .withColumn("stem", F.left(F.col("name"), F.length("name") - F.length(ending)))
        .withColumn("format", F.lower(F.substr(ending, F.lit(2))))
        .withColumn("depth", F.size(folders).cast("bigint"))
        .withColumn("readable", F.col("format").isin(*READABLE_FORMATS))
    )


def format_support(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("format", "readable").agg(F.count(F.lit(1)).alias("items"))


def chain(path: str | Column) -> Column:
    """Scopes from the root (the empty name) down to the path."""
    col = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(col, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scope_chain(rows: DataFrame, path: str = "folder") -> DataFrame:
    """One row per scope a path lies in, with its depth."""
    return rows.select("*", F.posexplode(chain(path)).alias("scope_depth", "scope"))


def folder_rollup(catalog: DataFrame) -> DataFrame:
    """Readable and other items of every folder, those of its sub-folders included."""
    per_folder = catalog.groupBy("folder").agg(
        F.count_if("readable").alias("_r"), F.count_if(~F.col("readable")).alias("_o")
    )
    return scope_chain(per_folder).groupBy("scope").agg(F.sum("_r").alias("readable"), F.sum("_o").alias("others"))


def catalog_signature(catalog: DataFrame, root: str | Column) -> DataFrame:
    """A value per root that changes when an item or folder comes, goes, moves or is renamed,
    and with nothing else.

    The names are hashed one by one and the hashes added up in eight lanes, so the order of
    arrival does not matter and no task ever holds the names of a root together.
    """
    digest = F.sha2(F.concat_ws("\n", F.lit("f"), F.col("path")), 256)
    lanes = [F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    col = F.col(root) if isinstance(root, str) else root
    sums = catalog.select(col.alias("root"), digest.alias("_d")).groupBy("root").agg(
        F.count(F.lit(1)).alias("items"),
        *[F.pmod(F.sum(lane), F.lit(1 << 32).cast("decimal(30,0)")).cast("bigint").alias(f"_l{i}") for i, lane in enumerate(lanes)],
    )
    whole = F.concat_ws("-", F.col("items").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(8)])
    return sums.select("root", "items", tx.short_hash(whole).alias("signature"))


def library_nodes(entries: DataFrame) -> DataFrame:
    """(path, parent, name, depth, kind, resolves) of everything a library shows: ``entries`` are (path,
    kind, resolves), kind ``dir``, ``file`` or ``link``, and every folder that a path lies in, listed or not.

    Reserved names, names at the top that begin with a dot, and files that do are not shown, nor is what
    lies inside them. A link is shown as a file; ``resolves`` tells whether it leads anywhere.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    hidden = F.exists(parts, lambda p: p.isin(*RESERVED)) | F.get(parts, F.lit(0)).startswith(".") | (
        (F.col("kind") != "dir") & F.element_at(parts, -1).startswith(".")
    )
    shown = entries.where(F.size(parts) > 0).where(~hidden).withColumn("_parts", parts)
    inner = F.when(F.col("kind") == "dir", F.col("_parts")).otherwise(F.slice("_parts", 1, F.size("_parts") - 1))
    folders = shown.select(F.explode(chain(F.array_join(inner, "/"))).alias("path")).where("path <> ''").distinct()
    files = shown.where("kind <> 'dir'").groupBy(F.array_join("_parts", "/").alias("path")).agg(
        F.bool_or((F.col("kind") == "file") | F.coalesce("resolves", F.lit(False))).alias("resolves")
    )
    every = folders.select("path", F.lit("dir").alias("kind"), F.lit(True).alias("resolves")).unionByName(
        files.select("path", F.lit("file").alias("kind"), "resolves")
    )
    split = F.split("path", "/")
    parent = F.array_join(F.slice(split, 1, F.size(split) - 1), "/")
    return every.select("path", parent.alias("parent"), F.element_at(split, -1).alias("name"), F.size(split).alias("depth"), "kind", "resolves")


def tree_signature(nodes: DataFrame) -> DataFrame:
    """(path, children, signature) of every folder, the root (the empty path) among them: a value that
    changes when anything inside comes, goes, moves, is renamed, or a link breaks or is mended, and with
    nothing else; two folders of the same inside have the same one.

    Folded from the leaves, a level a round: a folder's value is made of those of its children, added up
    in eight lanes, so a folder with a third of all names is summed by every task before it meets. Empty
    folders are nodes like others. A level is written before the next one reads it.
    """
    nodes = session.written(nodes, "tree_nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    empty = F.sha2(F.lit(""), 256)
    file = nodes.where("kind = 'file'").select(
        "depth", "parent", F.sha2(F.concat(F.lit("f:"), "name", F.lit(":"), F.col("resolves").cast("int").cast("string")), 256).alias("_d")
    )
    below, found = None, []
    for depth in range(deepest, -1, -1):
        children = file.where(F.col("depth") == depth + 1).select("parent", "_d")
        if below is not None:
            inner = F.sha2(F.concat(F.lit("d["), "name", F.lit("\n"), "signature", F.lit("]")), 256)
            children = children.unionByName(below.select("parent", inner.alias("_d")))
        lanes = [F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
        sums = children.groupBy("parent").agg(
            F.count(F.lit(1)).alias("children"),
            *[F.pmod(F.sum(lane), F.lit(1 << 32).cast("decimal(30,0)")).cast("bigint").alias(f"_l{i}") for i, lane in enumerate(lanes)],
        )
        whole = F.concat_ws("-", F.col("children").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(8)])
        hashed = sums.select(F.col("parent").alias("path"), "children", F.sha2(whole, 256).alias("signature"))
        if depth:
            own = nodes.where((F.col("kind") == "dir") & (F.col("depth") == depth)).select("path", "parent", "name")
        else:
            own = nodes.sparkSession.createDataFrame([("", None, "")], "path string, parent string, name string")
        level = own.join(hashed, "path", "left").select(
            "path", "parent", "name", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("signature", empty).alias("signature")
        )
        below = session.written(level, "tree_level")
        found.append(below)
    return functools.reduce(DataFrame.unionByName, found).select("path", "children", F.left("signature", F.lit(16)).alias("signature"))


def tree_rows(catalog: DataFrame, levels: int) -> DataFrame:
    """The catalog as the rows of a tree: a folder, its sub-folders, then its files, by folded name.

    Folders are open down to ``levels``; rows inside a closed folder are left out. ``sort_key``
    orders the rows; it is a column, so that the order costs a sort only where one is wanted.
    """
    folders = (
        catalog.select("folder").distinct().select(F.explode(chain("folder")).alias("path")).distinct()
        .where("path <> ''").withColumn("is_file", F.lit(False))
    )
    files = catalog.where("folder <> ''").select("path", F.lit(True).alias("is_file"))
    rows = folders.unionByName(files)
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    # A file counts as level "1" beside the sub-folders at level "0" of the same folder.
    key = F.transform(
        parts,
        lambda p, i: F.concat(F.when(F.col("is_file") & (i == depth), "1").otherwise("0"), tx.fold_case(p)),
    )
    return rows.where(depth <= levels).select("path", "is_file", depth.cast("bigint").alias("depth"), F.array_join(key, "\u0002").alias("sort_key"))


def numbered_name(name: Column, n: Column) -> Column:
    """``stem (n).ending`` from the second item on."""
    ending = F.regexp_extract(name, r"\A.+(\.[^.]+)\z", 1)
    stem = F.when(ending == "", name).otherwise(F.left(name, F.length(name) - F.length(ending)))
    return F.when(n == 1, name).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ending))


def unique_names(items: DataFrame, order: str) -> DataFrame:
    """Give every further item of one name in a folder the name ``stem (n).ext``, n from 2.

    A number is skipped where an item of the folder really has that name. ``order`` is a whole
    number unique per item. The r-th copy gets the r-th free number, which is r + 1 plus the taken
    numbers at or below it: a running count, done in shards, as a folder may hold one name very often.
    """
    own = F.regexp_extract("name", r"\A(.*) \((\d+)\)(\.[^.]+)?\z", 2).try_cast("bigint")
    base = F.regexp_replace("name", r"\A(.*) \((\d+)\)(\.[^.]+)?\z", "$1$3")
    taken = (
        items.select("folder", base.alias("_base"), own.alias("_t")).where(F.col("_t") >= 2).distinct()
        .withColumnRenamed("_base", "name")
    )
    ranked_taken = scale.sharded_rank(taken, ["folder", "name"], "_t", "_j", start=0).drop("shard")
    # Before each of these positions one number is missing.
    gaps = ranked_taken.select("folder", "name", (2 * (F.col("_t") - F.col("_j"))).alias("_at"), F.lit(1).alias("_v"))
    ranked = scale.sharded_rank(items, ["folder", "name"], order, "_n").drop("shard")
    copies = ranked.select("folder", "name", (2 * F.col("_n") + 1).alias("_at"), F.lit(0).alias("_v"))
    events = scale.sharded_running_total(gaps.unionByName(copies), ["folder", "name"], "_at", "_v", "_shift")
    shifts = events.where("_v = 0").select("folder", "name", F.shiftright("_at", 1).alias("_n"), "_shift")
    number = F.when(F.col("_n") > 1, F.col("_n") + F.col("_shift")).otherwise(F.lit(1))
    return (
        ranked.join(shifts, ["folder", "name", "_n"])
        .withColumn("unique_name", numbered_name(F.col("name"), number)).drop("_n", "_shift")
    )


def _doubled(rows: DataFrame, rounds: int, text: bool) -> tuple[list[DataFrame], DataFrame]:
    """Walk up from every node of ``rows`` (id, up, path, levels), twice as far each round.

    A row holds what lies from the node to just before ``up``; joined with the row of ``up`` it holds
    both halves. Rows that have reached the top (``up`` is null) leave the work. Returned are these, a
    table a round, and what is still open after ``rounds``.
    """
    rows = session.written(rows, "hierarchy_walk")
    done, still = [rows.where("up IS NULL")], rows.where("up IS NOT NULL")
    for _ in range(rounds):
        if still.isEmpty():
            break
        halves = functools.reduce(DataFrame.unionByName, [still, *done])
        halves = halves.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("levels").alias("_levels"))
        path = F.concat("_path", F.lit("/"), "path") if text else F.col("path")
        met = still.join(halves, F.col("up") == F.col("_id")).select(
            "id", F.col("_up").alias("up"), path.alias("path"), (F.col("levels") + F.col("_levels")).alias("levels")
        )
        met = session.written(met, "hierarchy_walk")
        done.append(met.where("up IS NULL"))
        still = met.where("up IS NOT NULL")
    return done, still


def _cycle_paths(nodes: DataFrame, on_cycle: DataFrame, rounds: int, text: bool) -> DataFrame:
    """(id, up, path, levels) of nodes on a cycle: once around it, up to the node itself.

    A cycle is cut above its least id. From there down every node has a distance, and the walk up from
    a node is first the nodes at smaller distances, then those at larger ones.
    """
    ring = session.written(nodes.join(on_cycle, "id").select("id", "up", "name"), "hierarchy_ring")
    least = ring.select("id", "up", F.col("id").alias("leader"))
    for _ in range(rounds):
        other = least.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("leader").alias("_leader"))
        met = least.join(other, F.col("up") == F.col("_id"))
        least = session.written(met.select("id", F.col("_up").alias("up"), F.least("leader", "_leader").alias("leader")), "hierarchy_least")
    leaders = least.select("id", "leader")
    cut = ring.join(leaders, "id").withColumn("up", F.when(F.col("id") != F.col("leader"), F.col("up")))
    walked, _ = _doubled(cut.select("id", "up", F.lit("").alias("path"), F.lit(1).cast("bigint").alias("levels")), rounds, False)
    at = functools.reduce(DataFrame.unionByName, walked).select("id", F.col("levels").alias("at"))
    placed = session.written(ring.join(leaders, "id").join(at, "id").select("id", "leader", "name", "at"), "hierarchy_placed")
    if text:  # a path names the whole cycle, so a row with all its names is no larger than a row of the result
        around = placed.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("_all"))
    else:
        around = placed.groupBy("leader").agg(F.count(F.lit(1)).alias("_all"))
    size = F.size("_all").cast("bigint") if text else F.col("_all")
    here = F.col("at").cast("int")
    path = F.array_join(F.concat(F.slice("_all", here + 1, F.size("_all")), F.slice("_all", F.lit(1), here)), "/") if text else F.lit("")
    return placed.join(around, "leader").select("id", F.lit(None).cast("bigint").alias("up"), path.alias("path"), size.alias("levels"))


def hierarchy_paths(spark: SparkSession, nodes: DataFrame, text: bool = True) -> DataFrame:
    """(id, path, levels) of every node of a table ``(id, parent, name)``, ids whole numbers: its full path
    and the number of names in it; without ``text`` the path is left empty and only levels are counted.

    Pointer doubling: every round joins half paths to paths twice as long, so a tree of any depth takes
    the logarithm of its depth in rounds, and each round is a written table. A parent that is not in the
    table counts as none. What is still open after as many rounds as the table can be deep leads to a
    cycle: its nodes are those the walks ended at. They are walked once around and then count as the tops
    of the trees below them. A node met before ends a walk, so a node on a cycle of n has n levels. Of rows that
    repeat an id the one of least name counts.
    """
    first = F.min_by(F.struct("parent", "name"), F.struct(F.coalesce("name", F.lit("")), F.coalesce("parent", F.lit(-1))))
    one = nodes.where("id IS NOT NULL").groupBy(F.col("id").cast("bigint").alias("id")).agg(first.alias("_n"))
    one = one.select("id", F.col("_n.parent").cast("bigint").alias("parent"), F.coalesce("_n.name", F.lit("")).alias("name"))
    one = session.written(one, "hierarchy_nodes")
    known = one.select(F.col("id").alias("up"))
    linked = one.where("parent IS NOT NULL").join(known, F.col("parent") == F.col("up")).select("id", "up", "name")
    tops = one.join(linked.select("id"), "id", "left_anti").select("id", F.lit(None).cast("bigint").alias("up"), "name")
    rows = session.written(linked.unionByName(tops), "hierarchy_rows")
    rounds = max(1, rows.count().bit_length())

    def start(df: DataFrame, named: bool) -> DataFrame:
        return df.select("id", "up", (F.col("name") if named else F.lit("")).alias("path"), F.lit(1).cast("bigint").alias("levels"))

    # numbers first: on a cycle texts would double with every round
    done, still = _doubled(start(rows, False), rounds, False)
    ring = None
    if not still.isEmpty():
        on_cycle = session.written(still.select(F.col("up").alias("id")).distinct(), "hierarchy_cycle")
        ring = session.written(_cycle_paths(rows, on_cycle, rounds, text), "hierarchy_ring_paths")
    if text or ring is not None:
        trees = start(rows, text)
        if ring is not None:
            trees = trees.join(ring.select("id"), "id", "left_anti").unionByName(ring)
        done, _ = _doubled(trees, rounds, text)
    return functools.reduce(DataFrame.unionByName, done).select("id", "path", "levels")


def reject_reason() -> Column:
    """Why an item cannot be imported, or null; needs ``name`` and ``n_bytes``."""
    cleaned = F.btrim(tx.strip("name"), F.lit(". "))
    return (
        F.when(F.col("n_bytes") == 0, "empty file")
        .when(F.col("n_bytes") > MAX_BYTES, "over 200 MB")
        .when(cleaned == "", "empty name")
        .when(F.length(cleaned) > MAX_NAME, "name too long")
    )


def import_triage(items: DataFrame) -> DataFrame:
    """Every item with ``reject_reason``; null means it goes in. One bad item stops no other."""
    return items.withColumn("reject_reason", reject_reason())


def split_triage(triaged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return triaged.where("reject_reason IS NULL").drop("reject_reason"), triaged.where("reject_reason IS NOT NULL")
