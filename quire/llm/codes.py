"""Compression of vectors to short codes: one codebook for each part of a vector, fitted in whole numbers
by Lloyd's rounds that look at active entries only.

A part keeps the entry it is assigned to and the exact distance to it. After a round some entries have
moved. A part whose entry stayed compares its stored distance with the moved entries alone: the others
are as far away as before, when they lost. A part whose entry moved looks at all of them. Of equal
distances the lower index wins, as in a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import lasting
from quire.session import forgotten

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

#: Whole numbers below this are worked on in 64 bits, which then cannot overflow; others as Python's own.
NARROW = 1 << 26
LARGEST = (1 << 63) - 1

STATE = "vec_id {id}, label {label}, parts array<string>, narrow array<bigint>, entry binary, distance array<string>, near array<bigint>"


def whole(x: float) -> int:
    """floor(SCALE * x), exact for any finite number."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE))


def cuts(width: int) -> list[int]:
    """Where the parts of a vector begin and end; equal lengths where the width allows."""
    return [width * i // PARTS for i in range(PARTS + 1)]


def numbers(rows: list[list[int]]) -> np.ndarray:
    """Rows of whole numbers as a matrix: 64 bits where nothing can overflow, else Python's numbers."""
    if not rows or not rows[0]:
        return np.zeros((len(rows), 0), np.int64)
    wide = np.array(rows, dtype=object)
    return wide if max(map(abs, wide.ravel().tolist())) >= NARROW else wide.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each entry."""
    if x.shape[1] == 0:
        return np.zeros((len(x), len(book)), np.int64)
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    differ = x[:, None, :] - book[None, :, :]
    return (differ * differ).sum(axis=2)


def first_least(d: np.ndarray) -> np.ndarray:
    return d.argmin(axis=1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)


def active_assignment(
    x: np.ndarray, book: np.ndarray, moved: np.ndarray, entry: np.ndarray, distance: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row and its distance, from those of the round before."""
    entry, distance = entry.copy(), distance.copy() if book.dtype != object else distance.astype(object)
    lost = moved[entry]
    rows = np.flatnonzero(lost)
    if len(rows):
        d = distances(x[rows], book)
        best = first_least(d)
        if d.dtype == object:
            distance = distance.astype(object)
        entry[rows], distance[rows] = best, d[np.arange(len(rows)), best]
    rows, active = np.flatnonzero(~lost), np.flatnonzero(moved)
    if len(rows) and len(active):
        d = distances(x[rows], book[active])
        best = first_least(d)
        near, index = d[np.arange(len(rows)), best], active[best]
        better = ((near < distance[rows]) | ((near == distance[rows]) & (index < entry[rows]))).astype(bool)
        if d.dtype == object:
            distance = distance.astype(object)
        entry[rows[better]], distance[rows[better]] = index[better], near[better]
    return entry, distance


@dataclass
class Books:
    """Entries of every part, and which of them moved in the last round; ``None`` before the first one."""

    entries: list[list[list[int]]]
    moved: list[list[bool]] | None = None

    def after(self, totals: dict[tuple[int, int], tuple[int, list[int]]]) -> Books:
        """The means of the parts assigned to each entry, rounded down; an entry without any stays."""
        new = [
            [[s // totals[p, e][0] for s in totals[p, e][1]] if (p, e) in totals else old for e, old in enumerate(book)]
            for p, book in enumerate(self.entries)
        ]
        return Books(new, [[a != b for a, b in zip(x, y)] for x, y in zip(self.entries, new)])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for book in self.entries for e in book for c in e).encode()).hexdigest()


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, vector) of the rows that are kept."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("vector")).where(good)


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1]))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).ravel()))


def entries_of(batch: pa.RecordBatch) -> np.ndarray | None:
    """The entry of every part, as the state holds them; None before the first round."""
    stored = batch.column(4).to_pylist()
    return np.frombuffer(b"".join(stored), np.uint8).reshape(len(stored), PARTS) if stored and stored[0] is not None else None


def as_state(kept: DataFrame, width: int) -> DataFrame:
    """Whole numbers of the vectors: 64 bits in ``narrow``, or as text in ``parts`` where one is too large."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            plain = (np.abs(x) < NARROW // SCALE).all(axis=1)
            if plain.all():
                narrow, wide = lists(np.floor(x * SCALE).astype(np.int64)), pa.nulls(n, pa.list_(pa.string()))
            else:
                rows = list(zip(plain.tolist(), x.tolist()))
                narrow = pa.array([[whole(v) for v in r] if ok else None for ok, r in rows], pa.list_(pa.int64()))
                wide = pa.array([None if ok else [str(whole(v)) for v in r] for ok, r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), wide, narrow,
                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64())),
                ],
                names=STATE_NAMES,
            )

    return kept.where(F.size("vector") == width).mapInArrow(work, shape_of(kept))


STATE_NAMES = ["vec_id", "label", "parts", "narrow", "entry", "distance", "near"]


def shape_of(rows: DataFrame) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return STATE.format(id=kinds["vec_id"], label=kinds["label"])


def groups_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch that are worked on together, as (places, matrix): the narrow ones, and the wide ones."""
    for column in (3, 2):
        at = np.flatnonzero(batch.column(column).is_valid().to_numpy(zero_copy_only=False))
        if len(at):
            if column == 3:
                flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
                yield at, flat.reshape(len(at), -1)
            else:
                yield at, np.array([[int(c) for c in r] for r in batch.column(column).to_pylist() if r is not None], dtype=object)


def assigned(state: DataFrame, books: Books, width: int) -> DataFrame:
    """Every part's nearest entry and exact distance, found from those that the state holds."""
    edge, shape = cuts(width), shape_of(state)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = [numbers(book) for book in books.entries]
        for batch in batches:
            n = batch.num_rows
            entry, near = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), object)
            stored = entries_of(batch) if books.moved is not None else None
            known, all_narrow = stored is not None, True
            for at, x in groups_of(batch):
                out_e, out_d = np.zeros((len(at), PARTS), np.int64), np.zeros((len(at), PARTS), object)
                if known:
                    old_e, old_d = stored[at].astype(np.int64), distances_of(batch, at)
                for p, book in enumerate(matrices):
                    part = x[:, edge[p] : edge[p + 1]]
                    if known:
                        out_e[:, p], out_d[:, p] = active_assignment(part, book, np.array(books.moved[p]), old_e[:, p], narrowed(old_d[:, p]))
                    else:
                        d = distances(part, book)
                        best = first_least(d)
                        out_e[:, p], out_d[:, p] = best, d[np.arange(len(at)), best]
                entry[at], near[at] = out_e, out_d
                all_narrow &= x.dtype != object and max(out_d.ravel().tolist(), default=0) <= LARGEST
            if all_narrow:
                low, high = lists(near.astype(np.int64)), pa.nulls(n, pa.list_(pa.string()))
            else:
                fits = [max(row) <= LARGEST for row in near.tolist()]
                low = pa.array([row if ok else None for row, ok in zip(near.tolist(), fits)], pa.list_(pa.int64()))
                high = pa.array([None if ok else [str(v) for v in row] for row, ok in zip(near.tolist(), fits)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([e.tobytes() for e in entry], pa.binary()), high, low], names=STATE_NAMES
            )

    return state.select(*STATE_NAMES).mapInArrow(work, shape)


def distances_of(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    near, wide = batch.column(6), batch.column(5)
    if near.null_count == 0:
        return near.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PARTS)[at]
    low, high = near.to_pylist(), wide.to_pylist()
    return np.array([low[i] if low[i] is not None else [int(v) for v in high[i]] for i in at.tolist()], dtype=object)


def narrowed(d: np.ndarray) -> np.ndarray:
    return d.astype(np.int64) if d.dtype != object or max(d.tolist(), default=0) <= LARGEST else d


def totals(state: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sums of the parts assigned to each entry: one row an entry from every task, added up on
    Spark, so that PARTS * ENTRIES rows come to the driver whatever the number of vectors."""
    edge = cuts(width)
    shape = "part int, entry int, n bigint, sums array<string>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], list] = {}
        for batch in batches:
            stored = entries_of(batch)
            for at, x in groups_of(batch):
                entry = stored[at].astype(np.int64)
                for p in range(PARTS):
                    part = x[:, edge[p] : edge[p + 1]]
                    for e in np.unique(entry[:, p]).tolist():
                        rows = part[entry[:, p] == e]
                        have = own.setdefault((p, e), [0, [0] * part.shape[1]])
                        have[0] += len(rows)
                        have[1] = [a + int(b) for a, b in zip(have[1], rows.sum(axis=0).tolist())]
        yield rows_of(own)

    def rows_of(own: dict) -> pa.RecordBatch:
        keys = sorted(own)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([own[k][0] for k in keys], pa.int64()), pa.array([[str(s) for s in own[k][1]] for k in keys], pa.list_(pa.string())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    def add(table: pa.Table) -> pa.Table:
        sums = [[int(v) for v in row] for row in table.column("sums").to_pylist()]
        key = (table.column("part")[0].as_py(), table.column("entry")[0].as_py())
        return pa.Table.from_batches([rows_of({key: [sum(table.column("n").to_pylist()), [sum(c) for c in zip(*sums)]]})])

    added = state.select(*STATE_NAMES).mapInArrow(gather, shape).groupBy("part", "entry").applyInArrow(add, shape)
    return {(r.part, r.entry): (r.n, [int(v) for v in r.sums]) for r in added.collect()}


def encode(
    vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label"
) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error), and the codebooks: vectors as one entry index for each part.

    Components become floor(SCALE * x); a vector is cut into PARTS equal parts (where its width does
    not divide, lengths differ by one). The codebooks begin with the parts of the ENTRIES smallest ids;
    each round assigns every part to its nearest entry, then moves each entry to the mean of its parts,
    rounded down. ``code`` holds an index in two hexadecimal digits for each part, ``error`` the sum of
    the squared distances.

    Vectors that are null, or hold null or non-finite components, are left out, as are those of another
    width than the vector of smallest id. With fewer than ENTRIES vectors the codebooks are shorter.
    Rows that repeat an id are rows of their own, ordered by their components; a missing id comes after
    all others. Numbers of any size are exact; an error beyond 64 bits is given as the largest one. An
    empty table gives no rows and empty codebooks. Other columns are not read.

    The vectors are never shuffled: each round reads the rows of the round before and writes them with
    their new entries, so a lost executor costs one task of one round; the table before is then removed.
    """
    kept = finite_vectors(vectors, id_col, vector_col, label_col)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    width = len(first[0].vector) if first else 0
    same = kept.where(F.size("vector") == width)
    seeds = same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    whole_seeds, edge = [[whole(x) for x in r.vector] for r in seeds], cuts(width)
    books = Books([[s[a:z] for s in whole_seeds] for a, z in zip(edge, edge[1:])])
    state = lasting(as_state(kept, width), "vector_state")
    for _ in range(rounds if seeds else 0):
        before, state = state, lasting(assigned(state, books, width), "vector_state")
        forgotten(before)
        books = books.after(totals(state, width))
    last = assigned(state, books, width) if seeds else state
    exact = F.aggregate("near", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    error = F.when(F.col("near").isNull() | (exact > LARGEST), F.lit(LARGEST)).otherwise(exact.cast("bigint"))
    digits = F.lower(F.hex("entry"))
    done = lasting(last.select("vec_id", "label", digits.alias("code"), error.alias("error")), "vector_codes")
    forgotten(state)
    return done, books


def digests(vectors: DataFrame) -> DataFrame:
    """Codes with the error summed over equal labels (one sum a label, joined back) and a digest of the codebooks."""
    done, books = encode(vectors)
    per = done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")).withColumnRenamed("label", "_label")
    total = F.least(F.col("_sum"), F.lit(LARGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error")
    return done.join(per, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", total, F.lit(books.digest()).alias("codebooks_sha256")
    )


def oracle() -> str:
    """The same rounds as one statement: every part looks at every entry in each round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), part AS MATERIALIZED (
  SELECT r, p, c[p * (len(c) // {PARTS}) + 1:(p + 1) * (len(c) // {PARTS})] AS v FROM kept, range(0, {PARTS}) AS t(p)
), book0 AS MATERIALIZED (SELECT p, (r - 1)::INTEGER AS e, v FROM part WHERE r <= {ENTRIES})"""
    ]
    near = """near{i} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT part.r, part.p, b.e, list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM part JOIN book{i} AS b USING (p)
  ) GROUP BY r, p
)"""
    move = """sums{i} AS MATERIALIZED (
  SELECT p, e, list(s ORDER BY k) AS v FROM (
    SELECT p, e, k, (s - ((s % n) + n) % n) // n AS s FROM (
      SELECT part.p, m.e AS e, k, sum(part.v[k])::BIGINT AS s, count(*) AS n
      FROM part JOIN near{i} USING (r, p), range(1, 1 + (SELECT max(len(v)) FROM part)) AS t(k) GROUP BY part.p, m.e, k
    )
  ) GROUP BY p, e
), book{j} AS MATERIALIZED (SELECT book{i}.p, book{i}.e, coalesce(sums{i}.v, book{i}.v) AS v FROM book{i} LEFT JOIN sums{i} USING (p, e))"""
    for i in range(ROUNDS):
        steps += [near.format(i=i), move.format(i=i, j=i + 1)]
    steps.append(near.format(i=ROUNDS))
    steps.append(f"""coded AS MATERIALIZED (
  SELECT r, string_agg(lower(printf('%02x', m.e::INTEGER)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
)""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


ORACLE = oracle()
