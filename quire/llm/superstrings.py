"""Repeats over windows of words or bytes, found bucket by bucket from packed strings.

Every window of ``k`` units takes the smallest hash of its ``m``-unit parts as its anchor, so equal
windows have equal anchors. Consecutive windows with one anchor travel as one packed string to the
bucket of that anchor; strings of a bucket are compressed together. Buckets that hold far more than
their share are split by document; what is repeated inside a part is known there, and one copy of
every other window goes on, as a 128-bit hash, to a second round spread by that hash.

A document is known by ``k1`` and ``k2``: its id, and a 32-bit hash of id and text that tells rows
of one id apart. Results are intervals
of units, joined back to the texts once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import lasting, partitions

#: Units of text worked on at once, and bytes of packed strings held before they are sent on.
PIECE, HELD = 1 << 18, 32 << 20
#: Level of compression of packed strings, which are most of what is shuffled.
LEVEL = 6
#: Buckets for each shuffle partition; a bucket over HOT times the mean is split, unless its strings
#: are so few (SMALL, some MB) that one task has them at ease. Windows of a bucket of the second round.
BUCKETS, HOT, SMALL, SECOND = 16, 4, 20_000, 1 << 19
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_C = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _C
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def rolled(h: np.ndarray, length: int, base: int = int(_B)) -> np.ndarray:
    """Polynomial hash of every ``length`` neighbours of ``h``, by doubling; shorter at the end by length - 1."""
    out, have, done = h, 1, None
    offset = 0
    left = length
    while left:
        if left & 1:
            if done is None:
                done = out
            else:
                part = out[offset : offset + len(done)]
                n = min(len(done), len(part))
                done = done[:n] * np.uint64(pow(base, have, 1 << 64)) + part[:n]
            offset += have
        left >>= 1
        if left:
            out = out[:-have] * np.uint64(pow(base, have, 1 << 64)) + out[have:]
            have *= 2
    return done


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` neighbours."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


@dataclass(frozen=True)
class Units:
    """What a window is made of."""

    k: int
    m: int
    words: bool

    def joined(self, strings: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The strings as one text, and the first byte of each with the end of the last."""
        gap = b"\n" if self.words else b""
        return gap.join(strings), np.cumsum([0] + [len(x) + len(gap) for x in strings])

    def pieces(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """(first unit, bytes) of a text, cut so that every window is in one piece."""
        if not self.words:
            for at in range(0, max(1, len(raw) - self.k + 1), PIECE):
                yield at, raw[at : at + PIECE + self.k - 1]
            return
        words, step = raw.split(), PIECE // 8
        for at in range(0, max(1, len(words) - self.k + 1), step):
            yield at, b" ".join(words[at : at + step + self.k - 1])

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every unit: first byte, end, and hash."""
        b = np.frombuffer(text, dtype=np.uint8)
        if not self.words:
            at = np.arange(len(b), dtype=np.int64)
            return at, at + 1, b.astype(np.uint64) + np.uint64(1)
        space = _SPACE[b]
        inside = ~space
        first = inside.copy()
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return starts, starts, np.empty(0, np.uint64)
        last = inside.copy()
        last[:-1] &= space[1:]
        ends = np.flatnonzero(last) + 1
        within = np.maximum(np.arange(len(b)) - starts[np.maximum(np.cumsum(first) - 1, 0)], 0)
        value = np.where(inside, b.astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers(int(within.max()) + 1)[within]
        return starts, ends, mix(np.add.reduceat(value, starts))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64), _B)
        p[0] = 1
        _POWERS = np.cumprod(p)
    return _POWERS


@dataclass
class Runs:
    """Runs of windows with one anchor in a piece of text: piece number, first and last window,
    anchor, and whether the anchor's place changes within the run."""

    piece: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray
    varied: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def runs_of(text: bytes, bounds: np.ndarray, units: Units) -> Runs | None:
    """Runs in joined pieces; ``bounds`` are the pieces' first bytes and the end of the last."""
    starts, ends, h = units.places(text)
    if len(h) < units.k:
        return None
    w = units.k - units.m + 1
    g = mix(rolled(h, units.m))
    key = (g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype=np.uint64)
    low = sliding_min(key, w)
    piece = np.searchsorted(bounds, starts, side="right") - 1
    n = len(low)
    valid = piece[:n] == piece[units.k - 1 : units.k - 1 + n]
    value = low >> np.uint64(20)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (value[1:] != value[:-1])
    first = np.flatnonzero(begins)
    if not len(first):
        return None
    closes = valid.copy()
    closes[:-1] &= ~valid[1:] | (value[1:] != value[:-1])
    stop = np.flatnonzero(closes) + 1
    return Runs(piece[first], first, stop, value[first], low[first] != low[stop - 1], starts, ends)


def chunks(raws: list[bytes], units: Units) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """Texts joined into pieces of bounded size: (document number and first unit) of each, bytes, bounds."""
    held: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    for i, raw in enumerate(raws):
        for at, part in units.pieces(raw):
            if size and size + len(part) > 3 * PIECE:
                yield owners, *units.joined(held)
                held, owners, size = [], [], 0
            held.append(part)
            owners.append((i, at))
            size += len(part) + 1
    if held:
        yield owners, *units.joined(held)


def bucket_counts(units: Units, buckets: int) -> Callable:
    """Packed strings of each bucket, as each task counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            raws = [(t or "").encode() for t in b.column("text").to_pylist()]
            for _, text, bounds in chunks(raws, units):
                if (r := runs_of(text, bounds, units)) is not None:
                    total += np.bincount((mix(r.anchor) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def pack(units: Units, buckets: int, parts: dict[int, int]) -> Callable:
    """Packed strings, compressed together by bucket and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        many = np.ones(buckets, np.int64)
        for k, n in parts.items():
            many[k] = n
        held: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = sorted(held)
            blobs = []
            for key in keys:
                rows = held[key]
                numbers = np.concatenate([x[0] for x in rows], axis=1)
                text = b"".join(b"".join(x[1]) for x in rows)
                narrow = numbers[2:].astype(np.int32).tobytes()
                blobs.append(squeeze.compress(np.int64(numbers.shape[1]).tobytes() + numbers[:2].tobytes() + narrow + text))
            held.clear()
            at = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(at >> 24), pa.array(at & 0xFFFFFF), pa.array(blobs, pa.binary())], names=["bucket", "part", "blob"]
            )

        for b in batches:
            raws = [(t or "").encode() for t in b.column("text").to_pylist()]
            k1, k2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for owners, text, bounds in chunks(raws, units):
                r = runs_of(text, bounds, units)
                if r is None:
                    continue
                doc, at = np.array(owners).T
                # number of the piece's first unit, so that unit numbers count from the text's start
                zero = np.searchsorted(r.starts, bounds[:-1])
                bucket = (mix(r.anchor) % np.uint64(buckets)).astype(np.int64)
                own1, own2 = k1[doc[r.piece]], k2[doc[r.piece]]
                part = ((own1 ^ own2).view(np.uint64) % many[bucket].astype(np.uint64)).astype(np.int64)
                lo, hi = r.starts[r.first], r.ends[r.stop - 1 + units.k - 1]
                begin = at[r.piece] + r.first - zero[r.piece]
                # of the anchor 30 bits tell it apart in its bucket; equal ones are only looked at together
                tag = (r.anchor & np.uint64((1 << 30) - 1)).astype(np.int64) * 2 + r.varied
                numbers = np.stack([own1, begin, own2, r.stop - r.first, hi - lo, tag])
                key = bucket << 24 | part
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order])) + 1
                los, his = lo[order].tolist(), hi[order].tolist()
                numbers = numbers[:, order]
                first = 0
                for stop in [*cuts.tolist(), len(order)]:
                    strings = [text[x:y] for x, y in zip(los[first:stop], his[first:stop])]
                    held.setdefault(int(key[order[first]]), []).append((numbers[:, first:stop], strings))
                    first = stop
                size += int((hi - lo).sum())
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


#: (texts) -> for every window of every text, in order, whether another of these windows equals it.
Repeats = Callable[[list[bytes]], np.ndarray]


def window_hashes(strings: list[bytes], units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of the strings, in order."""
    text, bounds = units.joined(strings)
    starts, _, h = units.places(text)
    piece = np.searchsorted(bounds, starts, side="right") - 1
    n = len(h) - units.k + 1
    valid = piece[:n] == piece[units.k - 1 : units.k - 1 + n]
    one = mix(rolled(h, units.k))[valid]
    two = mix(rolled(mix(h ^ _C), units.k, 0xA0761D6478BD642F | 1))[valid]
    return one, two


def spans(flags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows inside each string: (string, first, stop), from flags laid end to end."""
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins, closes = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1] | (owner[1:] != owner[:-1])
    closes[:-1] &= ~flags[1:] | (owner[1:] != owner[:-1])
    a, z = np.flatnonzero(begins), np.flatnonzero(closes)
    return owner[a], within[a], within[z] + 1


OUT = "kind bigint, k1 bigint, k2 bigint, lo bigint, hi bigint, blob binary"


def bucket_repeats(units: Units, repeats: Repeats, parts: dict[int, int], second: int) -> Callable:
    """Intervals of repeated units in one part of a bucket; for split buckets also the hashes of its
    distinct windows, packed by the buckets of the second round."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        numbers, strings = [], []
        for blob in table.column("blob").to_pylist():
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            wide = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
            narrow = np.frombuffer(raw, np.int32, 4 * n, 8 + 16 * n).reshape(4, n).astype(np.int64)
            at = 8 + 32 * n + np.concatenate([[0], np.cumsum(narrow[2])])
            numbers.append(np.concatenate([wide, narrow]))
            strings += [raw[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        k1, begin, k2, windows, _, tag = np.concatenate(numbers, axis=1)
        split = parts.get(int(key[0].as_py()), 1) > 1
        anchor, varied = tag >> 1, (tag & 1).astype(bool)
        _, inverse, count = np.unique(anchor, return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        # equal strings: all their windows are repeated; the first stands for them from here on
        first: dict[bytes, int] = {}
        leader = np.arange(len(strings))
        for i in np.flatnonzero(shared).tolist():
            leader[i] = first.setdefault(strings[i], i)
        copied = np.zeros(len(strings), bool)
        again = np.flatnonzero(leader != np.arange(len(strings)))
        copied[again] = copied[leader[again]] = True
        alone = leader == np.arange(len(strings))
        distinct = np.bincount(inverse[alone], minlength=len(count))
        look = np.flatnonzero(alone & ((distinct[inverse] > 1) | varied))
        lo, hi, owner = [np.zeros(len(again), np.int64)], [windows[again]], [again]
        flagged: dict[int, np.ndarray] = {}
        if len(look):
            flags = repeats([strings[i] for i in look.tolist()])
            flags |= np.repeat(copied[look], windows[look])
            who, a, z = spans(flags, windows[look])
            lo.append(a), hi.append(z), owner.append(look[who])
            if split:
                flagged = dict(zip(look.tolist(), np.split(flags, np.cumsum(windows[look])[:-1])))
        seen = np.zeros(len(strings), bool)
        seen[look] = True
        plain = np.flatnonzero(alone & copied & ~seen)
        lo.append(np.zeros(len(plain), np.int64)), hi.append(windows[plain]), owner.append(plain)
        lo, hi, owner = map(np.concatenate, (lo, hi, owner))
        n = len(lo)
        out = [np.zeros(n, np.int64), k1[owner], k2[owner], begin[owner] + lo, begin[owner] + hi + units.k - 1, [None] * n]
        extra: list[tuple[int, bytes]] = []
        if split:
            keep = np.flatnonzero(alone)
            one, two = window_hashes([strings[i] for i in keep.tolist()], units)
            where = np.repeat(keep, windows[keep])
            place = np.arange(len(where)) - np.repeat(np.cumsum(windows[keep]) - windows[keep], windows[keep]) + begin[where]
            # one of each window that this part holds more than once
            order = np.lexsort((two, one))
            new = np.ones(len(order), bool)
            new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            pick = order[new]
            rows = np.stack([one[pick].view(np.int64), two[pick].view(np.int64), k1[where[pick]], k2[where[pick]], place[pick]])
            to = (one[pick] % np.uint64(second)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            for s in np.split(order, cuts):
                extra.append((int(to[s[0]]), zstandard.compress(rows[:, s].tobytes(), 3)))
        blank = np.zeros(len(extra), np.int64)
        cols = [
            np.concatenate([out[0], blank + 1]), np.concatenate([out[1], np.array([x[0] for x in extra], np.int64)]),
            np.concatenate([out[2], blank]), np.concatenate([out[3], blank]), np.concatenate([out[4], blank]),
        ]
        return pa.table(
            [*(pa.array(c.astype(np.int64)) for c in cols), pa.array(out[5] + [x[1] for x in extra], pa.binary())],
            names=["kind", "k1", "k2", "lo", "hi", "blob"],
        )

    return run


def second_round(units: Units) -> Callable:
    """Windows that more than one part of a split bucket holds, from their hashes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(zstandard.decompress(b), np.int64).reshape(5, -1) for b in table.column("blob").to_pylist()], axis=1)
        order = np.lexsort((rows[1], rows[0]))
        rows = rows[:, order]
        eq = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
        dup = np.zeros(rows.shape[1], bool)
        dup[1:] |= eq
        dup[:-1] |= eq
        k1, k2, at = rows[2][dup], rows[3][dup], rows[4][dup]
        order = np.lexsort((at, k2, k1))
        k1, k2, at = k1[order], k2[order], at[order]
        return pa.table([pa.array(x) for x in (k1, k2, at, at + units.k)], names=["k1", "k2", "lo", "hi"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k1, k2): 96 bits of hashes of id and text tell rows apart, whatever the id's type and
    with or without one. Rows equal in both share them, and their repeats, too."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.xxhash64(id_col, text_col).alias("k1"), F.hash(id_col, text_col).cast("bigint").alias("k2"),
    )


def repeated_units(docs: DataFrame, units: Units, repeats: Repeats, small: int = SMALL) -> DataFrame:
    """(k1, k2, at): for every document with repeats, the intervals of its repeated units. The
    result does not depend on which buckets are split."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = BUCKETS * n
    counts = docs.select("text").mapInArrow(bucket_counts(units, buckets), "bucket bigint, n bigint")
    counts = lasting(counts.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(small, HOT * total // buckets)
    # at most buckets / HOT of them
    hot = {r.bucket: r.n for r in counts.where(F.col("n") > most).collect()}
    parts = {k: int(-(-2 * v // most)) for k, v in hot.items()}
    packed = docs.select("k1", "k2", "text").mapInArrow(pack(units, buckets, parts), "bucket bigint, part bigint, blob binary")
    second = max(n, sum(hot.values()) * (units.k - units.m) // SECOND)
    found = packed.groupBy("bucket", "part").applyInArrow(bucket_repeats(units, repeats, parts, second), OUT)
    found = lasting(found, "repeats") if parts else found
    rows = found.where("kind = 0").select("k1", "k2", "lo", "hi")
    if parts:
        hashes = found.where("kind = 1").select(F.col("k1").alias("second"), "blob")
        more = hashes.groupBy("second").applyInArrow(second_round(units), "k1 bigint, k2 bigint, lo bigint, hi bigint")
        rows = rows.union(more)
    return rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("at"))


def merged(at: list | None) -> list[tuple[int, int]]:
    """Intervals in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for x in sorted((i["lo"], i["hi"]) for i in at or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append([*x])
    return [(a, z) for a, z in out]


def without_repeats(docs: DataFrame, units: Units, repeats: Repeats, id_col: str, text_col: str, small: int = SMALL) -> DataFrame:
    """(doc_id, kept, n_units, n_removed, n_spans, spans) of every row; ``kept`` is binary."""
    texts = keyed(docs, id_col, text_col)
    joined = texts.join(repeated_units(texts, units, repeats, small), ["k1", "k2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in batches:
            kept, n, gone, cuts = [], [], [], []
            for text, at in zip(b.column("text").to_pylist(), b.column("at").to_pylist()):
                raw = (text or "").encode()
                have = raw.split() if units.words else raw
                parts = merged(at)
                last, rest = 0, []
                for lo, hi in parts:
                    rest.append(have[last:lo])
                    last = hi
                rest.append(have[last:])
                kept.append(b" ".join(w for x in rest for w in x) if units.words else b"".join(rest))
                n.append(len(have))
                gone.append(sum(z - a for a, z in parts))
                cuts.append([{"lo": a, "hi": z} for a, z in parts])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array([len(c) for c in cuts], pa.int64()), pa.array(cuts, kind)],
                names=["doc_id", "kept", "n_units", "n_removed", "n_spans", "spans"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, kept binary, n_units bigint, n_removed bigint, n_spans bigint, spans array<struct<lo:bigint,hi:bigint>>"
    return joined.select("doc_id", "text", "at").mapInArrow(run, schema)
