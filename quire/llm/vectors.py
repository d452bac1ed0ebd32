"""Near-duplicate vectors by sorted projection passes.

A pass orders all vectors lexicographically by the signs of random projections and compares each with
a bounded window of neighbours in double precision. Verified links of all passes are united into
components. The passes only save work: after them, every pair of vectors of different components is
compared, tile against tile, so no link is left to chance. How many vectors each one links with is then counted inside its component: two vectors
within half the threshold's angle of the component's centre are linked without comparing them, and
only the others are compared, block against block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import components, lasting, partitions, text_hash

THRESHOLD = 0.9
PASSES, WINDOW, BITS, SEED = 32, 32, 60, 20
#: Vectors of a component that one task compares with as many others.
BLOCK = 1024
#: Numbers of the vectors of a tile, and rows of it that are compared at a time.
TILE, STRIP = 1 << 19, 512


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one; None for a null, empty or zero vector or one with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.array(v, np.float64)
        if x is not None:
            # scaled first, so that squares of very large or small components stay finite
            most = np.abs(x).max()
            x = x / most if np.isfinite(most) and most > 0 and np.isfinite(x).all() else None
        out.append(None if x is None else x / np.linalg.norm(x))
    return out


def projections(dim: int, which: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, which]).standard_normal((dim, bits))


def sort_keys(x: np.ndarray, which: int, bits: int) -> np.ndarray:
    """Signs of one pass's projections, the first weighing most."""
    signs = (x @ projections(x.shape[1], which, bits)) > 0
    return signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


class Joined:
    """Union-find over row numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, i: int) -> int:
        while (j := self.up.get(i, i)) != i:
            self.up[i] = self.up.get(j, j)
            i = j
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def neighbour_links(rows: DataFrame, least: float, window: int) -> DataFrame:
    """(a, b) of rows (pass, dim, key, node, x) in sorted order: links in windows that join what the
    task has not joined yet. A window ends with its task's range; other passes cut elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None
        joined = Joined()
        for t in batches:
            if not t.num_rows:
                continue
            which, dim = t.column("pass").to_numpy(), t.column("dim").to_numpy()
            node = t.column("node").to_numpy()
            flat = t.column("x").flatten().to_numpy()
            ends = np.cumsum(dim)
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(dim) != 0)) + 1
            a, b = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(node)]):
                x = flat[ends[lo] - dim[lo] : ends[hi - 1]].reshape(hi - lo, -1)
                ids = node[lo:hi]
                if tail and tail[:2] == (which[lo], dim[lo]):
                    x, ids = np.concatenate([tail[3], x]), np.concatenate([tail[2], ids])
                fresh = len(ids) - (hi - lo)
                for step in range(1, min(window, len(ids) - 1) + 1):
                    close = np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= least)
                    for i in close[close + step >= fresh].tolist():
                        p, q = int(ids[i]), int(ids[i + step])
                        if p != q and joined.join(p, q):
                            a.append(p), b.append(q)
                tail = (which[lo], dim[lo], ids[-window:], x[-window:])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def passes(rows: DataFrame, count: int, bits: int) -> DataFrame:
    """Every vector once for each pass, with its sort key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            nodes, vectors = t.column("node").to_pylist(), unit_rows(t.column("x"))
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                x, ids = np.stack([vectors[i] for i in at]), pa.array([nodes[i] for i in at], pa.int64())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel()))
                for k in range(count):
                    full = lambda v: pa.array(np.full(len(at), v, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [full(k), full(dim), pa.array(sort_keys(x, k, bits)), ids, flat], names=["pass", "dim", "key", "node", "x"]
                    )

    return rows.mapInArrow(run, "pass bigint, dim bigint, key bigint, node bigint, x array<double>")


def links_between(classes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(a, b): links of components (or lone vectors) that the passes left apart, from all pairs of
    vectors (node, x) of one length. Small components share tiles, whole; one larger than a tile has
    tiles of its own, which are not compared with each other."""
    spark = classes.sparkSession

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = pa.array([v.tolist() for v in unit_rows(t.column("x"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([t.column("node"), t.column("comp"), x], names=["node", "comp", "x"])

    rows = classes.join(found, "node", "left").select("node", F.coalesce("component_id", "node").alias("comp"), "x")
    rows = rows.mapInArrow(units, "node bigint, comp bigint, x array<double>")
    rows = lasting(rows.withColumn("dim", F.size("x")), "vector_units")
    room = F.greatest(F.lit(1), F.floor(F.lit(TILE) / F.col("dim"))).cast("bigint")
    sizes = rows.groupBy("dim", "comp").agg(F.count(F.lit(1)).alias("n")).withColumn("room", room)
    small = {r.dim: -(-r.n // r.room) for r in sizes.where("n <= room").groupBy("dim", "room").agg(F.sum("n").alias("n")).collect()}
    # a row for each component larger than a tile: no more than there are tiles
    large, ends = [], dict(small)
    for r in sizes.where("n > room").orderBy("dim", "comp").collect():
        start = ends.get(r.dim, 0)
        ends[r.dim] = start + -(-r.n // r.room)
        large.append((r.comp, start, ends[r.dim]))
    if not ends:
        return spark.createDataFrame([], "a bigint, b bigint")
    own = spark.createDataFrame(large, "comp bigint, start bigint, end bigint")
    tiles = spark.createDataFrame([(d, small.get(d, 0), n) for d, n in ends.items()], "dim int, small bigint, tiles bigint")
    placed = rows.join(F.broadcast(own), "comp", "left").join(F.broadcast(tiles), "dim")
    tile = F.when(F.col("start").isNull(), F.expr("pmod(xxhash64(comp), small)")).otherwise(F.expr("start + pmod(xxhash64(node), end - start)"))
    placed = placed.withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    pairs = placed.select("dim", "tile", other, "node", "comp", "x", "start", "end").where("start IS NULL OR other < start OR other >= end")
    pairs = pairs.select("dim", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") <= F.col("other")).alias("first"), "comp", "x")

    def compared(t: pa.Table) -> pa.Table:
        first, comp = t.column("first").to_numpy(), t.column("comp").to_numpy()
        x = t.column("x").combine_chunks().flatten().to_numpy().reshape(len(comp), -1)
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        (x1, c1), (x2, c2) = (x[first], comp[first]), (x, comp) if same else (x[~first], comp[~first])
        y = x2.astype(np.float32).T
        joined = Joined()
        a, b = [], []
        for at in range(0, len(c1), STRIP):
            # single precision leaves out what is far from a link; double precision decides
            p, q = np.nonzero(x1[at : at + STRIP].astype(np.float32) @ y >= least - 1e-4)
            p += at
            apart = c1[p] != c2[q]
            p, q = p[apart], q[apart]
            for lo in range(0, len(p), 1 << 14):
                u, v = p[lo : lo + (1 << 14)], q[lo : lo + (1 << 14)]
                near = np.einsum("ij,ij->i", x1[u], x2[v]) >= least
                for m, n in zip(c1[u[near]].tolist(), c2[v[near]].tolist()):
                    if joined.join(m, n):
                        a.append(m), b.append(n)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.groupBy("dim", "i", "j").applyInArrow(compared, "a bigint, b bigint")


def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of vectors by component; a component has vectors of one length."""
    total: dict[int, np.ndarray] = {}
    for t in parts:
        for c, x in zip(t.column("component_id").to_pylist(), t.column("x").to_pylist()):
            total[c] = total[c] + np.array(x) if c in total else np.array(x)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
        names=["component_id", "x"],
    )


def link_counts(members: DataFrame, least: float) -> DataFrame:
    """(node, links): vectors in other classes linked with each class, from rows (node, component_id,
    copies, x) of components with several classes."""
    half = math.acos(least) / 2 - 1e-9
    spark = members.sparkSession
    sums = members.select("component_id", "x").mapInArrow(summed, "component_id bigint, x array<double>")
    centre = (
        sums.groupBy("component_id").applyInArrow(
            lambda t: pa.Table.from_batches([*summed(iter(t.to_batches()))]), "component_id bigint, x array<double>"
        ).withColumnRenamed("x", "c")
    )

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            core = []
            for x, c in zip(t.column("x").to_pylist(), t.column("c").to_pylist()):
                c = np.array(c)
                size = np.linalg.norm(c)
                core.append(bool(size > 0 and math.acos(min(1.0, max(-1.0, float(np.dot(x, c) / size)))) <= half))
            yield pa.RecordBatch.from_arrays(
                [*(t.column(n) for n in ("node", "component_id", "copies", "x")), pa.array(core, pa.bool_())],
                names=["node", "component_id", "copies", "x", "core"],
            )

    placed = members.join(centre, "component_id").select("node", "component_id", "copies", "x", "c")
    placed = lasting(
        placed.mapInArrow(angles, "node bigint, component_id bigint, copies bigint, x array<double>, core boolean"), "placed"
    )
    sizes = placed.groupBy("component_id").agg(
        F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"),
        F.count(F.when(~F.col("core"), 1)).alias("rim"), F.count(F.lit(1)).alias("all"),
    )
    rows = placed.join(sizes, "component_id")
    sure = rows.where("core").select("node", (F.col("core_copies") - F.col("copies")).alias("links"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    open_ = rows.where("rim > 0")
    rim = open_.where("NOT core").select(
        "component_id", at("rim").alias("i"), F.explode(F.sequence(F.lit(0), blocks("all") - 1)).alias("j"),
        "node", "copies", "x", F.lit(True).alias("rim"), "core",
    )
    every = open_.select(
        "component_id", F.explode(F.sequence(F.lit(0), blocks("rim") - 1)).alias("i"), at("all").alias("j"),
        "node", "copies", "x", F.lit(False).alias("rim"), "core",
    )

    def compared(t: pa.Table) -> pa.Table:
        is_rim = np.array(t.column("rim").to_pylist())
        core = np.array(t.column("core").to_pylist())
        node, copies = (t.column(c).to_numpy() for c in ("node", "copies"))
        x = np.array(t.column("x").to_pylist(), np.float64).reshape(len(node), -1)
        linked = (x[is_rim] @ x[~is_rim].T >= least) & (node[is_rim][:, None] != node[~is_rim][None, :])
        mine, theirs = linked @ copies[~is_rim], copies[is_rim] @ linked
        theirs = np.where(core[~is_rim], theirs, 0)  # what is not core counts its links itself
        out = np.concatenate([mine, theirs])
        return pa.table([pa.array(np.concatenate([node[is_rim], node[~is_rim]])), pa.array(out.astype(np.int64))], names=["node", "links"])

    more = rim.union(every).groupBy("component_id", "i", "j").applyInArrow(compared, "node bigint, links bigint")
    return sure.union(more).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, least: float = THRESHOLD, count: int = PASSES, window: int = WINDOW, bits: int = BITS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Links are cosines of at least ``least`` in double precision. Vectors that are null, empty or zero
    or hold null or non-finite components, and rows without an id, link with nothing; vectors of
    different lengths do not link. Equal vectors are one class under the smallest id and count as
    many; repeated rows are vectors of their own. ``component_id`` is null and ``kept`` false for a
    row without an id. An empty table gives no rows; other columns are not read. The result does not
    depend on ``count``, ``window`` and ``bits``: they set how much the passes find before all pairs
    of different components are compared, whose number grows with the square of the vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", number) & F.exists("x", lambda v: v != 0)
    h1, h2 = text_hash("x")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({"h1": h1, "h2": h2})
    classes = lasting(
        rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x")),
        "vector_classes",
    )
    keyed = passes(classes.select("node", "x"), count, bits)
    order = ["pass", "dim", "key", "node"]
    ranged = keyed.repartitionByRange(max(partitions(spark), count), *order).sortWithinPartitions(*order)
    found = lasting(components(neighbour_links(ranged, least, window), "a", "b"), "vector_components")

    more = lasting(links_between(classes.select("node", "x"), found, least), "vector_links")
    if not more.isEmpty():
        known = found.select(F.col("node").alias("a"), F.col("component_id").alias("b"))
        found = lasting(components(known.union(more), "a", "b"), "vector_components")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = pa.array([v.tolist() for v in unit_rows(t.column("x"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([t.column("node"), t.column("component_id"), t.column("copies"), x], names=["node", "component_id", "copies", "x"])

    members = classes.join(found, "node").select("node", "component_id", "copies", "x")
    members = lasting(members.mapInArrow(units, "node bigint, component_id bigint, copies bigint, x array<double>"), "vector_members")
    counts = link_counts(members, least)
    by_class = (
        classes.select("h1", "h2", "node", "copies").join(found, "node", "left").join(counts, "node", "left")
        .select("h1", "h2", F.coalesce("component_id", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = rows.select("vec_id", F.when(F.col("sound"), F.col("h1")).alias("h1"), F.when(F.col("sound"), F.col("h2")).alias("h2"))
    out = out.join(by_class, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*)::BIGINT AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN degree USING (vec_id)
"""
