"""Near-duplicate documents by exact Jaccard similarity of word shingles.

Sets lie in size bands so that linked sets share a band or lie in neighbouring ones. Two linked sets
of a band differ in at most ``d`` shingles, so when both are cut by hash into more than ``d`` parts,
some part is equal: the parts' hashes name tiles, and only sets of one tile are compared. Bitmaps of
hashed shingles bound the overlap from above; what passes is settled by intersecting sorted arrays.

Inside a tile every set is first compared with the tile's most connected member, which joins groups
of copies without pairing them all. Sets of a tile that are then still in different components are
compared with each other through their bitmaps.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import components, filter_place, key_filter, lasting, may_be_among, partitions
from quire.llm.superstrings import Units, mix, rolled

SHINGLE, PERCENT = 3, 90
#: Sets of a tile that one task compares with each other.
BLOCK = 2048
#: Parts that candidate pairs are verified in, one after another.
PORTIONS = 4


def size_bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band: a set and one of ``percent`` of its size are at most a band apart."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out)


class Tiles:
    """Tile keys of a set."""

    def __init__(self, percent: int):
        self.bands = size_bands(percent)
        self.percent = percent

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of sets in a band, and empty ones that may go without a key: one more equal part is
        certain for each of them."""
        largest = int(self.bands[band + 1]) - 1
        differ = 2 * largest * (100 - self.percent) // (100 + self.percent)
        spare = differ // 10
        return differ + 1 + spare, spare

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys of a sorted set in its own band and in the next, where it may be the smaller one."""
        own = int(np.searchsorted(self.bands, len(shingles), side="right")) - 1
        mixed = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
        high = shingles >> np.uint64(32)
        out = []
        for band in (own, own + 1):
            n, spare = self.parts(band)
            part = (high * np.uint64(n)) >> np.uint64(32)
            first = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            sums, number = np.add.reduceat(mixed, first), part[first]
            if n - len(first) > spare:
                rest = np.setdiff1d(np.arange(n, dtype=np.uint64), number)
                sums, number = np.concatenate([sums, np.zeros(len(rest), np.uint64)]), np.concatenate([number, rest])
            out.append(mix(sums + mix((np.uint64(band) << np.uint64(40)) + number)))
        return np.concatenate(out)

    def packed(self, shingles: np.ndarray) -> bytes:
        """The keys' low 48 bits, six bytes each. Keys that agree there by chance only cost a comparison."""
        return self.keys(shingles).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(keys: bytes) -> np.ndarray:
    out = np.zeros((len(keys) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def shingle_sets(raws: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, sorted distinct shingle hashes) of every text with words."""
    units = Units(k, 1, True)
    texts = [b" ".join(x.lower().split()) for x in raws]
    whole = [(i, x) for i, x in enumerate(texts) if x]
    at = 0
    while at < len(whole):
        stop, size = at, 0
        while stop < len(whole) and (stop == at or size + len(whole[stop][1]) < 1 << 20):
            size += len(whole[stop][1])
            stop += 1
        text, bounds = units.joined([x for _, x in whole[at:stop]])
        starts, _, h = units.places(text)
        edge = np.searchsorted(starts, bounds)
        g = mix(rolled(h, k)) if len(h) >= k else np.empty(0, np.uint64)
        for j in range(stop - at):
            lo, hi = int(edge[j]), int(edge[j + 1])
            if hi - lo >= k:
                yield whole[at + j][0], np.unique(g[lo : hi - k + 1])
            else:  # fewer words: the whole sequence is one shingle, told apart by its length
                one = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    one = mix(np.array([one]) + x)[0]
                yield whole[at + j][0], np.array([one])
        at = stop


def bitmap(shingles: np.ndarray) -> bytes:
    """About four bits for each shingle, a power of two of them."""
    bits = 64
    while bits < 4 * len(shingles) and bits < 1 << 17:
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, longer ones folded to the length of the shortest."""
    least = min(map(len, maps))
    rows = []
    for m in maps:
        x = np.frombuffer(m, np.uint64)
        while len(x) * 8 > least:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        rows.append(x)
    return np.stack(rows)


def may_link(size: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Of ``others``, those whose overlap with set i may be enough: every bit that only one has is a
    shingle that only it has."""
    a, b = size[i], size[others]
    mine = np.bitwise_count(bits[i] & ~bits[others]).sum(1, dtype=np.int64)
    theirs = np.bitwise_count(bits[others] & ~bits[i]).sum(1, dtype=np.int64)
    most = np.minimum(a - mine, b - theirs)
    return others[100 * most >= percent * (a + b - most)]


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, s1, s2): size and 128-bit identity of every set; 0 shingles without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            out = np.zeros((3, len(raws)), np.int64)
            for i, s in shingle_sets(raws, k):
                out[:, i] = identity(s)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["doc_id", "n", "s1", "s2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint")


def identity(s: np.ndarray) -> tuple[int, int, int]:
    one, two = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return len(s), int(one.view(np.int64)), int(two.view(np.int64))


def set_keys(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, s1, s2, keys) of every set that is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(percent)
        for b in batches:
            raws, ids = [(t or "").encode() for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            rows = [(ids[i], *identity(s)[1:], tiles.packed(s)) for i, s in shingle_sets(raws, k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "s1", "s2", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, s1 bigint, s2 bigint, keys binary")


def set_arrays(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """(node, n, bits, arr): bitmap and sorted shingles of the sets of ``nodes``, and perhaps of some others.
    Texts are told apart where they are read, by a small bitmap of the nodes; where there are too many
    nodes for one the texts are joined."""
    known = key_filter(nodes, "node")
    if known is None:
        docs = docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    place = filter_place("doc_id", known[1]) if known else F.lit(0).cast("bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if known:
                b = b.filter(pa.array(may_be_among(b.column(2).to_numpy(), known[0])))
            raws, ids = [(t or "").encode() for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            rows = [(ids[i], len(s), bitmap(s), s.tobytes()) for i, s in shingle_sets(raws, k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                names=["node", "n", "bits", "arr"],
            )

    some = docs.where("doc_id IS NOT NULL").select("doc_id", "text", place.alias("place"))
    return some.mapInArrow(run, "node bigint, n bigint, bits binary, arr binary")


def tile_rows(reps: DataFrame, buckets: int) -> DataFrame:
    """(key, node, size) of every tile with more than one set. Keys travel packed, by buckets."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            each = [unpacked(x) for x in b.column(1).to_pylist()]
            keys = np.concatenate(each)
            nodes = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(x) for x in each])
            to = ((keys >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for s in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                # inside a bucket 32 bits tell keys apart
                blob = zstandard.compress(nodes[s].tobytes() + keys[s].astype(np.uint32).tobytes(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([int(to[s[0]])]), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        raw = [zstandard.decompress(x) for x in table.column("blob").to_pylist()]
        nodes = np.concatenate([np.frombuffer(x, np.int64, len(x) // 12) for x in raw])
        keys = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8) for x in raw]).astype(np.int64)
        keys |= np.int64(key[0].as_py()) << 32
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
        keys, nodes = keys[new], nodes[new]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        some = size > 1
        return pa.table([pa.array(x[some]) for x in (keys, nodes, size)], names=["key", "node", "size"])

    packed = reps.select("node", "keys").mapInArrow(pack, "bucket bigint, blob binary")
    return packed.groupBy("bucket").applyInArrow(shared, "key bigint, node bigint, size bigint")


def verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets link. Bitmaps first; arrays meet only for pairs that pass.

    Every pair carries a bitmap on its way, so pairs are taken in ``PORTIONS``, one after another: the
    disk holds the bitmaps of one portion at a time. What passes is little."""
    small = arrays.select("node", "n", "bits")
    side = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = t.to_pydict()
            keep = []
            for i in range(t.num_rows):
                n = np.array([c["n_a"][i], c["n_b"][i]])
                keep.append(bool(len(may_link(n, folded([c["bits_a"][i], c["bits_b"][i]]), 0, np.array([1]), percent))))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("arr_a").to_pylist(), t.column("arr_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = lasting(pairs, "pairs")
    portions = []
    for k in range(PORTIONS):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(PORTIONS)) == k)
        with_bits = some.join(side(small, "a"), F.col("a") == F.col("node_a")).join(side(small, "b"), F.col("b") == F.col("node_b"))
        near = with_bits.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(bounded, "a bigint, b bigint")
        portions.append(lasting(near, "near_pairs"))
    near = functools.reduce(DataFrame.unionByName, portions)
    full = arrays.select("node", "arr")
    met = near.join(side(full, "a"), F.col("a") == F.col("node_a")).join(side(full, "b"), F.col("b") == F.col("node_b"))
    return met.select("a", "b", "arr_a", "arr_b").mapInArrow(exact, "a bigint, b bigint").distinct()


def open_pairs(rows: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one tile in different components that the bitmaps don't rule out.

    ``rows`` are (key, node, size, component_id) of tiles with several components. A tile of more
    than ``BLOCK`` sets is cut into blocks, and every pair of blocks is a task's work of its own.
    """
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), n).cast("int")
    cut = rows.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = cut.select("key", "node", "component_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    wide = cut.join(arrays.select("node", "n", "bits"), "node")
    wide = wide.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")

    def compare(nodes, comps, own, sizes, maps, cross: bool) -> tuple[list, list]:
        bits, size = folded(maps), np.array(sizes)
        comps, own = np.array(comps), np.array(own)
        a, b = [], []
        for i in range(len(nodes) - 1):
            others = np.arange(i + 1, len(nodes))
            # sizes ascend: what is too large for set i ends the list
            others = others[: np.searchsorted(size[i + 1 :], size[i] * 100 // percent, side="right")]
            others = others[comps[others] != comps[i]]
            if cross:
                others = others[own[others] != own[i]]
            for o in may_link(size, bits, i, others, percent) if len(others) else ():
                a.append(max(nodes[i], nodes[o])), b.append(min(nodes[i], nodes[o]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None

        def done() -> pa.RecordBatch:
            nodes, comps, own, sizes, maps = zip(*held)
            a, b = compare(nodes, comps, own, sizes, maps, now[1] != now[2])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for t in batches:
            c = t.to_pydict()
            for key, i, j, *row in zip(*(c[x] for x in ("key", "i", "j", "node", "component_id", "own", "n", "bits"))):
                if (key, i, j) != now:
                    if len(held) > 1:
                        yield done()
                    now, held = (key, i, j), []
                held.append(row)
        if len(held) > 1:
            yield done()

    cols = ["key", "i", "j", "node", "component_id", "own", "n", "bits"]
    return wide.select(*cols).mapInArrow(run, "a bigint, b bigint").distinct()


def near_components(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set of ``k``-word shingles,
    and the smallest id reachable over links of at least ``percent`` of the union.

    Words are runs of characters other than ASCII white space, A-Z lowered. A text with fewer than
    ``k`` words has one shingle, the whole sequence; without words, or null, it has none and links
    with nothing. Equal sets are one class under their smallest id from the start. Rows with one id
    are one document: each keeps its own size, and links of any count for all. A row without an id
    belongs to the component of its set, or to none (null) when no row of that set has an id. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    member = lasting(sets(docs, k), "sets")
    classes = member.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    reps = (
        set_keys(docs, k, percent).groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
        .where("node IS NOT NULL")
    )
    tiles = lasting(tile_rows(reps, 4 * partitions(spark)), "tiles")
    degree = lasting(tiles.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    chief = tiles.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("b"))
    arrays = lasting(set_arrays(docs, k, degree), "arrays")
    star = tiles.join(chief, "key").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    links = lasting(verified(star, arrays, percent), "star_links")
    found = lasting(components(links, "a", "b"), "found")
    placed = tiles.join(found, "node", "left").withColumn("component_id", F.coalesce("component_id", "node"))
    mixed = placed.groupBy("key").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x != y")
    pairs = open_pairs(placed.join(mixed.select("key"), "key", "left_semi"), arrays, percent)
    more = lasting(verified(pairs, arrays, percent), "more_links")
    if not more.isEmpty():
        found = components(links.union(more), "a", "b")
    by_set = classes.join(found, "node", "left").select("s1", "s2", F.coalesce("component_id", "node").alias("component_id"))
    linked = member.join(by_set, ["s1", "s2"], "left")
    lone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), lone.alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 90 * (na.n + nb.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1
"""
