"""Periodic runs of words in whole texts, by string synchronising sets.

A run is a stretch of words with a smallest period ``q`` and at least two periods long that no
neighbouring word extends. At scale ``t`` (1, 2, 4, ...) a synchronising set picks positions by
content alone: ``i`` is in it when the least hash of the ``t``-word fragments that begin in
``i .. i+t`` belongs to the first or the last of them, fragments of a period of ``t/3`` at most
left aside. So wherever the same ``2t`` words stand, the same positions are picked, and any ``t``
neighbouring places hold one unless their words are highly periodic. A run of period ``4t <= q < 8t``
therefore holds two picked positions ``q`` apart with equal contexts of ``2t`` words: such pairs
propose periods, which are then extended word by word.

Two kinds of runs have no such pair and are found apart: periods of 1 to 3 words, by comparing words
that far from each other; and runs whose whole first period lies in a highly periodic region. The
second period then lies in another region of the same small period that touches the first, so each
pair of touching regions proposes the distances at which the one's words fall on the other's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are worked on together: texts are laid side by side up to this many, a longer text alone.
TOGETHER = 150_000
LEAST = 12

_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _U(0x9E3779B97F4A7C15) + b + _U(0x632BE59BD9B4E019))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, a power of two plus one, by doubling."""
    reach = 1
    while reach < width - 1:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:-1], x[1:])


class Symbols:
    """Words of several texts as numbers, each text closed by a number of its own, and the runs found."""

    def __init__(self, sym: np.ndarray):
        self.sym, self.n = sym, len(sym)
        self.found: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.by_period: dict[int, list[tuple[int, int]]] = {}
        self.touching: list[tuple[int, int, int, int, int]] = []  # r, start of both regions, shift, longest distance

    def equal_reach(self, s: int, d: int) -> tuple[int, int]:
        """The longest stretch of places around ``s`` whose words equal those ``d`` further on."""
        sym, x, step = self.sym, s, 32
        last = self.n - d
        while x < last:
            k = min(step, last - x)
            differ = sym[x : x + k] != sym[x + d : x + d + k]
            at = int(differ.argmax())
            if differ[at]:
                x += at
                break
            x, step = x + k, min(2 * step, 65536)
        y, step = s, 32
        while y > 0:
            k = min(step, y)
            differ = sym[y - k : y] != sym[y + d - k : y + d]
            at = int(differ[::-1].argmax())
            if differ[k - 1 - at]:
                y -= at
                break
            y, step = y - k, min(2 * step, 65536)
        return y, x

    def keep(self, start: int, end: int, q: int) -> None:
        """A stretch of period ``q`` that nothing extends. One that also has a smaller period is
        found with that one as well, with the same ends, so the smaller stays."""
        self.found[start, end] = min(q, self.found.get((start, end), q))

    def propose(self, s: np.ndarray, d: np.ndarray) -> None:
        """Extend each (place, distance); places inside a stretch just found are passed over."""
        order = np.lexsort((s, d))
        s, d = s[order], d[order]
        cuts = np.flatnonzero(np.diff(d, prepend=-1)).tolist() + [len(d)]
        for a, z in zip(cuts, cuts[1:]):
            q, own, at = int(d[a]), s[a:z], 0
            while at < len(own):
                lo, hi = self.equal_reach(int(own[at]), q)
                if hi - lo >= q:
                    self.keep(lo, hi + q, q)
                at = max(at + 1, int(np.searchsorted(own, hi)))

    def small_periods(self) -> None:
        for q in (1, 2, 3):
            eq = np.zeros(max(self.n - q, 0) + 2, np.int8)
            eq[1:-1] = self.sym[:-q] == self.sym[q:] if self.n > q else 0
            edge = np.flatnonzero(np.diff(eq))
            a, z = edge[::2], edge[1::2]
            long = z - a >= q
            for lo, hi in zip(a[long].tolist(), z[long].tolist()):
                self.keep(lo, hi + q, q)

    def settle(self, low: int, high: int) -> None:
        """Runs of periods from ``low`` to under ``high`` are all known: list them, and their pairs that touch."""
        fresh: dict[int, list[tuple[int, int]]] = {}
        for (start, end), q in self.found.items():
            if low <= q < high:
                fresh.setdefault(q, []).append((start, end))
        for r, runs in fresh.items():
            runs.sort()
            self.by_period[r] = runs
            for (b1, e1), (b2, e2) in zip(runs, runs[1:]):
                far = min(e1 - b1, e2 - b2)
                if e1 >= b2 and far >= 12 * r:
                    turn = self.turn(b1, b2, r)
                    if turn is not None:
                        self.touching.append((r, b1, b2, (b2 + turn - b1) % r, far))

    def turn(self, b1: int, b2: int, r: int) -> int | None:
        """How far into the second region the first one's first ``r`` words stand; None where they are others."""
        root, hay = self.sym[b1 : b1 + r].tobytes(), self.sym[b2 : b2 + 2 * r].tobytes()
        at = hay.find(root)
        while at >= 0 and at % 8:
            at = hay.find(root, at + 1)
        return at // 8 if at >= 0 else None

    def from_touching(self, low: int, high: int) -> None:
        for r, b1, b2, rest, far in self.touching:
            q = low + (rest - low) % r
            while q < min(high, far + 1):
                lo, hi = self.equal_reach(max(b1, b2 - q), q)
                if hi - lo >= q:
                    self.keep(lo, hi + q, q)
                q += r

    def periodic_places(self, t: int, n: int) -> np.ndarray | None:
        """Places whose next ``t`` words have a period of ``t/3`` at most; None where there are none."""
        edge = np.zeros(n + 1, np.int32)
        some = False
        for r, runs in self.by_period.items():
            if 3 * r <= t:
                for start, end in runs:
                    if end - start >= t:
                        edge[start] += 1
                        edge[end - t + 1] -= 1
                        some = True
        return np.cumsum(edge[:n]) > 0 if some else None

    def scale(self, t: int, h: np.ndarray) -> np.ndarray:
        """Runs of period 4t to under 8t. ``h`` are hashes of the fragments of ``t`` words; those of 2t are returned."""
        context = joined_hash(h[:-t], h[t:])
        key = np.minimum(h, _NONE - _U(1))
        periodic = self.periodic_places(t, len(h))
        if periodic is not None:
            key = np.where(periodic, _NONE, key)
        least = window_min(key, t + 1)
        n = min(len(least), len(context))
        least = least[:n]
        picked = ((key[:n] == least) | (key[t : t + n] == least)) & (least != _NONE)
        place = np.flatnonzero(picked)
        order = np.argsort(context[place], kind="stable")
        place = place[order]
        same = context[place]
        at, lag = np.arange(len(place)), 0
        starts, gaps = [], []
        while len(at):
            lag += 1
            at = at[at + lag < len(place)]
            gap = place[at + lag] - place[at]
            near = (same[at + lag] == same[at]) & (gap < 8 * t)
            at, gap = at[near], gap[near]
            far = gap >= 4 * t
            starts.append(place[at[far]])
            gaps.append(gap[far])
        s, d = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*gaps, np.zeros(0, np.int64)])
        # the stretch around a pair is 4t long at least, so t more words are equal before or behind its context
        after, before = s + 2 * t, s - t
        right = h[np.minimum(after, len(h) - 1)] == h[np.minimum(after + d, len(h) - 1)]
        left = h[np.maximum(before, 0)] == h[np.maximum(before + d, 0)]
        likely = ((after + d < len(h)) & right) | ((before >= 0) & left)
        self.propose(s[likely], d[likely])
        self.from_touching(4 * t, 8 * t)
        return context


def all_runs(sym: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run in ``sym``; ``longest`` bounds the length of a text in it."""
    work = Symbols(np.ascontiguousarray(sym, dtype=np.int64))
    work.small_periods()
    work.settle(1, 4)
    h, t = mixed(work.sym.view(_U) + _U(0x9E3779B97F4A7C15)), 1
    while 8 * t <= longest and 2 * t < len(h):
        h = work.scale(t, h)
        work.settle(4 * t, 8 * t)
        t *= 2
    return [(start, end, q) for (start, end), q in work.found.items()]


def runs_of_texts(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of at least ``least`` words, by start and period, for each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # long texts need more scales than short ones, so texts of a like length go together
    order = sorted((i for i, words in enumerate(texts) if len(words) >= least), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and (size == 0 or size + len(texts[order[end]]) <= TOGETHER):
            size += len(texts[order[end]]) + 1
            end += 1
        group, at = order[at:end], end
        numbers: dict[bytes, int] = {}
        sym = np.empty(size, np.int64)
        begin, x = [], 0
        for k, i in enumerate(group):
            words = texts[i]
            for w in dict.fromkeys(words):
                numbers.setdefault(w, len(numbers))
            sym[x : x + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            begin.append(x)
            x += len(words) + 1
            sym[x - 1] = -1 - k
        starts = np.array(begin)
        for start, stop, q in all_runs(sym, len(texts[group[-1]])):
            if stop - start >= least:
                k = int(np.searchsorted(starts, start, side="right")) - 1
                out[group[k]].append((start - begin[k], stop - start, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, less those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int32)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): every run of at least ``least`` words of every whole text.

    Words are runs of characters other than the six ASCII white-space ones, unchanged, numbered from
    0. ``runs`` are structs of start, length and period by start, then period; ``collapsed`` are the
    words joined by a space without those that a run holds after its first period, as UTF-8 bytes.
    No shuffle: a text is worked out where it is read, in memory in proportion to its words. A null
    or empty text has no words and no runs; equal rows give equal rows, each its own; a null id stays
    null; an empty table gives no rows; other columns are not read, so their names do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            runs = runs_of_texts(texts, least)
            flat = [r for own in runs for r in own]
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            parts = pa.StructArray.from_arrays(
                [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(map(len, texts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), parts),
                    pa.array([without_repeats(w, r) for w, r in zip(texts, runs)], pa.binary()),
                ],
                names=[id_col, "n_words", "runs", "collapsed"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    shape = "array<struct<start:bigint,length:bigint,period:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, n_words bigint, runs {shape}, collapsed binary")


def longest_run(runs: str) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("run")))
    return F.array_max(ranked)["run"]


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, chosen by a checksum of its id, with its end replaced by a
    repetition of words of its own: with ``h`` the checksum, ``g = h // 10`` and ``n`` words, each word
    from ``a = g % n`` on becomes word ``a + (i - a) % p``, where ``p = 1 + (n - a) // (3 + g % 8)``.
    The texts of the others stay as they are. A missing id has no checksum: its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.translate("text", "\t\x0b\x0c\r\n", "     "), " "), lambda w: w != "")
    base = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    g, n = F.floor(F.col("_h") / 10), F.size("_w")
    base = base.withColumn("_n", F.when(n > 0, n).cast("bigint")).withColumn("_a", g % F.col("_n"))
    base = base.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + g % 8)))
    a, p = F.col("_a"), F.col("_p")
    place = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
    turned = F.transform(place, lambda i: F.get("_w", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return base.select("doc_id", F.when(F.col("_n").isNull(), F.col("text")).otherwise(F.array_join(turned, " ")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest run, and digests of all runs and of the collapsed text, of :func:`looped` texts."""
    done = periodic_runs(looped(docs)).withColumn("_top", longest_run("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    top = F.col("_top")
    return done.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.expr("(1000 * _top.length) div _top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
