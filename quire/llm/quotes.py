"""Chat formatting by quotation linking.

Lines that begin with ``>`` quote an earlier message, one level for each mark. Quoted passages are
cut out, normalised and hashed, and joined to the message that wrote them: in the same conversation
first, anywhere else after that. A passage that is no whole text, paragraph or line of a message is
linked to the one that holds all its sentences in order, wherever its lines are wrapped. What a message quotes is what it answers, so the messages of a
conversation come out in reply order, without the quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.base import lasting, text_hash

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")


WORD = re.compile(r"[^\W_]+")
#: Ends of the units of a passage: of lines, and of sentences inside a line.
END = re.compile(r"\n|(?<=[.!?\u2026])[)\]\"']*[ \t]+|\.\.\.|\u2026")
#: Words of the windows by which units are looked up; a unit has the largest it has room for.
SIZES = (8, 4, 2, 1)


def parse(text: str | None) -> tuple[str, list[tuple[int, str, str]], list[str]]:
    """The text without quotes, its quoted passages with their levels and units, and what others may
    quote of it whole: the text, its paragraphs and its lines, normalised. Neighbouring lines of one level
    are one passage."""
    body: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        found = MARKS.match(line)
        level = found[1].count(">") if found else 0
        if level == 0:
            body.append(line)
        else:
            if level != before:
                quotes.append((level, []))
            quotes[-1][1].append(line[found.end() :])
        before = level
    own = "\n".join(body).strip()
    passages = [(level, plain("\n".join(lines)), units("\n".join(lines))) for level, lines in quotes]
    parts = {plain(own), *map(plain, re.split(r"\n[ \t]*\n", own)), *map(plain, own.split("\n"))}
    return own, [p for p in passages if p[1]], sorted(parts - {""})


def plain(text: str) -> str:
    """Lower case, one space between words."""
    return " ".join(text.lower().split())


def bare(text: str) -> str:
    """Runs of letters and digits in lower case, one space between."""
    return " ".join(WORD.findall(text.lower()))


def units(passage: str) -> str:
    """Words of the sentences of every line, a line each."""
    return "\n".join(u for u in map(bare, END.split(passage)) if u)


def holds(said: str, wanted: str) -> bool:
    """Whether the words ``said`` hold every unit as a run, one after the other."""
    text, at = f" {said} ", 0
    for unit in wanted.split("\n"):
        at = text.find(f" {unit} ", at)
        if at < 0:
            return False
        at += len(unit) + 1
    return True


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``body``, ``quotes`` (level, passage, units) and ``parts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int64()), ("passage", pa.string()), ("units", pa.string())]))
        for b in batches:
            got = [parse(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "turn", "role")), pa.array([g[0] for g in got], pa.string()),
                 pa.array([[{"level": n, "passage": p, "units": u} for n, p, u in g[1]] for g in got], kind),
                 pa.array([g[2] for g in got], pa.list_(pa.string()))],
                names=["conv_id", "turn", "role", "body", "quotes", "parts"],
            )

    schema = "conv_id bigint, turn bigint, role string, body string, quotes array<struct<level:bigint,passage:string,units:string>>, parts array<string>"
    ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
    return messages.select(*ids, F.col("role").cast("string").alias("role"), "text").mapInArrow(run, schema)


def windows(texts: DataFrame, sizes: list[int] | None) -> DataFrame:
    """The rows of ``texts``, whose last column is a text, once for each of its windows: of all
    ``sizes`` over its words, or else of each unit's own size; with ``size`` and the hash of the window."""
    *keys, last = texts.columns

    def cut(text: str) -> set[tuple[int, str]]:
        out = set()
        for unit in text.split("\n"):
            w = unit.split()
            for n in sizes or [next((k for k in SIZES if k <= len(w)), 0)]:
                out.update((n, " ".join(w[i : i + n])) for i in range(len(w) - n + 1) if n)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                found = [(i, *w) for i, t in enumerate(part.column(last).to_pylist()) for w in sorted(cut(t))]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in keys), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())],
                    names=[*keys, "size", "window"],
                )

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema[:-1]), "size bigint, window string"])
    h1, h2 = text_hash("window")
    return texts.mapInArrow(run, schema).withColumns({"w1": h1, "w2": h2}).drop("window")


def holders(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(conv_id, turn, u1, u2): messages that hold all of the distinct ``wanted`` (u1, u2, units) in
    order. Each is looked up by that window of its units which fewest messages have."""
    asked = lasting(windows(wanted.select("u1", "u2", "units"), None), "quote_windows")
    sizes = [r[0] for r in asked.select("size").distinct().collect()]

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = pa.array([bare(t or "") for t in b.column("body").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), said], names=["conv_id", "turn", "said"])

    ids = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "body")
    said = lasting(ids.mapInArrow(spoken, "conv_id bigint, turn bigint, said string").distinct(), "said")
    held = windows(said, sizes).join(asked.select("w1", "w2").distinct(), ["w1", "w2"], "left_semi")
    held = lasting(held.select("conv_id", "turn", "w1", "w2").distinct(), "said_windows")
    often = held.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, ["w1", "w2"], "left").fillna(0, ["n"]).groupBy("u1", "u2").agg(F.min(F.struct("n", "w1", "w2")).alias("w"))
    found = rarest.where("w.n > 0").select("u1", "u2", "w.w1", "w.w2").join(held, ["w1", "w2"])
    found = found.join(wanted, ["u1", "u2"]).join(said, ["conv_id", "turn"]).select("conv_id", "turn", "u1", "u2", "units", "said")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yes = [holds(s, u) for s, u in zip(b.column("said").to_pylist(), b.column("units").to_pylist())]
            yield b.select(["conv_id", "turn", "u1", "u2"]).filter(pa.array(yes, pa.bool_()))

    return found.mapInArrow(verified, "conv_id bigint, turn bigint, u1 bigint, u2 bigint").distinct()


def quote_links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, at, from_conv, from_turn) of every quoted passage; the source is null
    where no message wrote it. A passage's writer is its earliest one: an earlier turn of the same
    conversation that wrote it whole, else one that holds its units in order, else the first message
    of another that wrote it whole, else one that holds them. Writers are reduced to one for each
    passage before the join, so a passage that many wrote and many quote gives no products."""
    h1, h2 = text_hash("p")
    u1, u2 = text_hash("units")
    written = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode("parts").alias("p"))
    written = written.select("conv_id", "turn", h1.alias("h1"), h2.alias("h2"))
    quoted = rows.select("conv_id", "turn", F.posexplode("quotes").alias("at", "q"))
    quoted = quoted.select("conv_id", "turn", "at", F.col("q.level").alias("level"), F.col("q.passage").alias("p"), F.col("q.units").alias("units"))
    quoted = quoted.select("conv_id", "turn", "at", "level", h1.alias("h1"), h2.alias("h2"), u1.alias("u1"), u2.alias("u2"), "units")

    def sources(quoted: DataFrame, writers: DataFrame, key: list[str], name: str) -> DataFrame:
        """``quoted`` with its earlier turn here, ``name``_here, and its first writer elsewhere, ``name``_other."""
        here = writers.groupBy("conv_id", *key).agg(F.min("turn").alias("here"))
        # the first writer, and the last, which is in another conversation if any is
        first = writers.groupBy(*key).agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.max(F.struct("conv_id", "turn")).alias("last"))
        met = quoted.join(here, ["conv_id", *key], "left").join(first, key, "left")
        other = F.when(F.coalesce(F.col("first.conv_id") != F.col("conv_id"), F.lit(True)), F.col("first")).when(
            F.col("last.conv_id") != F.col("conv_id"), F.col("last")
        )
        return met.select(*quoted.columns, F.when(F.col("here") < F.col("turn"), F.col("here")).alias(f"{name}_here"), other.alias(f"{name}_other"))

    met = lasting(sources(quoted, written, ["h1", "h2"], "whole"), "quoted")
    open_ = lasting(met.where("whole_here IS NULL AND units != ''").select("u1", "u2", "units").dropDuplicates(["u1", "u2"]), "open_quotes")
    some = "conv_id bigint, turn bigint, u1 bigint, u2 bigint"
    found = rows.sparkSession.createDataFrame([], some) if open_.isEmpty() else lasting(holders(rows, open_), "holders")
    met = sources(met, found, ["u1", "u2"], "part")
    near = F.coalesce("whole_here", "part_here")
    other = F.coalesce("whole_other", "part_other")
    return met.select(
        "conv_id", "turn", "level", "at",
        F.when(near.isNotNull(), F.col("conv_id")).otherwise(other["conv_id"]).alias("from_conv"),
        F.when(near.isNotNull(), near).otherwise(other["turn"]).alias("from_turn"),
    )


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the turn at the start of every reply's chain, by pointer doubling."""
    spark = replies.sparkSession
    now = lasting(replies.select("conv_id", "turn", F.col("reply_turn").alias("thread")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        step = lasting(now.join(up, ["conv_id", "thread"], "left"), "threads")
        moved = step.where("above IS NOT NULL").limit(1).count()
        now = step.select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"))
        if not moved:
            return now


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, thread, reply_turn, n_quotes, n_linked, body) of every message.

    A message answers the last message of its own conversation that a passage of the lowest level it
    quotes was linked to; ``reply_turn`` is null for the others. ``thread`` is the turn that a chain
    of answers starts with, the message's own turn without one: ordered by conversation, thread and
    turn, every answer follows what it answers. Messages stay rows, so a conversation of any length
    is no single group. Null and empty texts have no quotes and write nothing; a message without
    conversation or turn is linked to others' passages, but nothing links to it; of repeated rows
    each is returned; an empty table gives no rows; other columns are not read.
    """
    rows = lasting(parsed(messages), "messages")
    links = lasting(quote_links(rows), "quote_links")
    own = links.where("from_conv = conv_id AND from_turn < turn")
    best = F.max_by("from_turn", F.struct(-F.col("level"), F.col("at"))).alias("reply_turn")
    replies = own.groupBy("conv_id", "turn").agg(best)
    linked = links.where("from_conv IS NOT NULL").groupBy("conv_id", "turn", "at").agg(F.lit(1).alias("one"))
    counts = linked.groupBy("conv_id", "turn").agg(F.count("one").alias("n_linked"))
    known = replies.join(threads(replies), ["conv_id", "turn"])
    side = counts.join(known, ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    out = rows.join(side, rows.conv_id.eqNullSafe(side._c) & rows.turn.eqNullSafe(side._t), "left")
    return out.select(
        "conv_id", "turn", "role", F.coalesce("thread", "turn").alias("thread"), "reply_turn",
        F.size("quotes").cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "body",
    )
