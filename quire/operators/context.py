"""What a question about a selection carries with it, and reading the streamed answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.operators import model
from quire.operators.markdown import portions
from quire.plans import scale
from quire.sources.views import PAGE

# The wording of a question's context below, and the reply that closes it.
ACKNOWLEDGEMENT = "Understood. What is your question?"


def wanted_pages(picked: Column, n_pages: Column, anchor: Column, most: int | None = None) -> Column:
    """Picked pages within the deck, sorted, all or the first ``most``, and always the page being read."""
    inside = F.array_sort(F.array_distinct(F.filter(picked, lambda p: (p >= 0) & (p < n_pages))))
    return F.array_sort(F.array_union(inside if most is None else F.slice(inside, 1, most), F.array(anchor)))


def ask_pages(requests: DataFrame, sizes: DataFrame) -> DataFrame:
    rows = scale.salted_join(requests, sizes, ["deck_id"], "page_index", how="inner")
    return rows.withColumn("wanted", wanted_pages(F.col("picked"), F.col("n_pages"), F.col("page_index")))


_PLACE = ["deck_id", "page_index", "block_index", "sent_index"]


def _line() -> Column:
    """A sentence as a question shows it, with its translation under it."""
    marker = F.when(F.col("kind") == "title", "# ").otherwise("- ")
    under = F.when(F.coalesce("translation", F.lit("")) != "", F.concat(F.lit("\n    "), "translation")).otherwise("")
    return F.concat(marker, "text", under)


def context_pages(titles: DataFrame, code: DataFrame, sentences: DataFrame, translations: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every page once: ``title``, ``lines`` (its text with the translation under each line) and ``chosen``,
    those of its sentences that some question selects, with their translations.

    Furniture is left out; blocks of ``code``, which are never split into sentences, stand whole.
    ``translations`` (place, translation) and ``chosen`` (place) hold a row a place and meet the texts
    where their page is put together, so a text is dealt out once.
    """
    split = sentences.where(model.worth_translating()).select(*_PLACE, "kind", "text")
    whole = code.select("deck_id", "page_index", "block_index", F.lit(0).cast("bigint").alias("sent_index"), "kind", "text")
    page = ["deck_id", "page_index"]

    def met(rows: DataFrame) -> DataFrame:
        return rows.repartition(*page).hint("merge")

    rows = met(split.unionByName(whole)).join(met(translations.select(*_PLACE, "translation")), _PLACE, "left")
    rows = rows.join(met(chosen.select(*_PLACE, F.lit(True).alias("_chosen"))), _PLACE, "left")
    lines = F.array_sort(F.collect_list(F.struct("block_index", "sent_index", _line().alias("line"))))
    picked = F.when(F.col("_chosen"), F.struct("block_index", "sent_index", "text", "translation"))
    grouped = rows.groupBy(*page).agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("lines"), F.collect_list(picked).alias("chosen")
    )
    return met(titles.select(*page, "title")).join(grouped.hint("merge"), page, "left").select(
        *page, "title", F.coalesce("lines", F.lit("")).alias("lines"), "chosen"
    )


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _pack(text: str) -> bytes:
    """Length and compressed bytes of a text."""
    plain = text.encode()
    return len(plain).to_bytes(8) + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(value: bytes) -> str:
    return pa.decompress(value[8:], int.from_bytes(value[:8]), codec="zstd", asbytes=True).decode()


def packed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the texts of a column compressed, for texts that travel in several copies: each alone,
    where Spark compresses a buffer of rows at a time and less."""
    names = [c for c in df.columns if c != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, len(names)):
                texts = [None if t is None else _pack(t) for t in rows.column(len(names)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(texts, pa.binary())], names=[*names, column])

    return df.select(*names, column).mapInArrow(work, f"{_schema(df, names)}, `{column}` binary")


#: Bytes of text that are put together at once.
PORTION = 1 << 20


def joined_sections(df: DataFrame, column: str) -> DataFrame:
    """``df`` with one text in place of an array of sections (heading, lines), whose lines are :func:`packed`."""
    names = [c for c in df.columns if c != column]

    def section(s: dict) -> str:
        lines = _unpack(s["lines"])
        return s["heading"] + ("\n" + lines if lines else "") + "\n"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sections, texts, start, held = batch.column(len(names)), [], 0, 0
            for i in range(batch.num_rows):
                texts.append("\n".join(section(s) for s in sections[i].as_py()))
                held += len(texts[-1])
                if held > PORTION or i == batch.num_rows - 1:
                    rows = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, column])
                    texts, start, held = [], i + 1, 0

    return df.select(*names, column).mapInArrow(work, f"{_schema(df, names)}, `{column}` string")


def selected_places(chosen: DataFrame, sentences: DataFrame) -> DataFrame:
    """Where chosen sentence ids stand: unknown ones are dropped, an id that stands in several places means
    the first. ``chosen`` is (request_id, deck_id, seq, sentence_id)."""
    place = F.struct("page_index", "block_index", "sent_index")
    first = sentences.where(model.worth_translating()).groupBy("deck_id", "sentence_id").agg(F.min(place).alias("_s"))
    return chosen.join(first, ["deck_id", "sentence_id"]).select("request_id", "deck_id", "seq", "sentence_id", "_s.*")


def selected_texts(places: DataFrame, pages: DataFrame) -> DataFrame:
    """``places`` numbered by ``n`` in each request, with the texts that :func:`context_pages` holds for them."""
    # numbered in shards: a request may hold most of all chosen sentences
    numbered = scale.sharded_rank(places, ["request_id"], "seq", "n").drop("shard").withColumn("n", F.col("n").cast("bigint"))
    return numbered.join(pages.select("deck_id", "page_index", F.inline("chosen")), _PLACE)


def selected_sentences(chosen: DataFrame, sentences: DataFrame) -> DataFrame:
    """Resolve chosen sentence ids: unknown ones are dropped, an id that stands in several places
    means the first. ``chosen`` is (request_id, deck_id, seq, sentence_id); ``n`` numbers the rest."""
    place = F.struct("page_index", "block_index", "sent_index")
    first = sentences.where(model.worth_translating()).groupBy("deck_id", "sentence_id").agg(
        F.min_by(F.struct("page_index", "block_index", "sent_index", "text", "translation"), place).alias("_s")
    )
    found = chosen.join(first, ["deck_id", "sentence_id"])
    rows = found.select("request_id", "deck_id", "seq", "sentence_id", "_s.*")
    # numbered in shards: a request may hold most of all chosen sentences
    return scale.sharded_rank(rows, ["request_id"], "seq", "n").drop("shard").withColumn("n", F.col("n").cast("bigint"))


def selection_text(selected: DataFrame) -> DataFrame:
    """The chosen sentences as a question shows them, numbered when there are several."""
    rows = selected.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "translation"))).alias("_s"))
    several = F.size("_s") > 1

    def line(s: Column) -> Column:
        lead = F.when(several, F.concat(F.lit("  "), s["n"].cast("string"), F.lit(". "))).otherwise("  ")
        shown = F.when(
            F.coalesce(s["translation"], F.lit("")) != "", F.concat(F.lit("\n     (shown to them as: "), s["translation"], F.lit(")"))
        ).otherwise("")
        return F.concat(lead, s["text"], shown)

    label = F.when(
        several, F.concat(F.lit("The student selected these "), F.size("_s").cast("string"), F.lit(" sentences:"))
    ).otherwise("The student selected this sentence:")
    return rows.select("request_id", F.concat(label, F.lit("\n"), F.array_join(F.transform("_s", line), "\n")).alias("selection"))


def bilingual_context(wanted: DataFrame, pages: DataFrame, selection: DataFrame, terms: DataFrame) -> DataFrame:
    """One context per question from the pages it wants, its selection and its deck's terms.

    ``pages`` is (deck_id, page_index, title, lines), the lines :func:`packed`: a page is copied to every
    question that wants it. What else a question shows is small and put together apart, so the copies are
    dealt out once.
    """
    request = ["request_id", "deck_id", "page_index"]
    asked = wanted.select(
        *request, (F.size("wanted") > 1).alias("_several"), F.explode("wanted").alias("_p")
    )
    held = pages.select("deck_id", F.col("page_index").alias("_p"), "title", "lines")
    dash = F.when(F.col("title") != "", F.concat(F.lit(" — "), "title")).otherwise("")
    here = F.col("_p") == F.col("page_index")
    heading = F.when(
        F.col("_several"),
        F.concat(F.lit("--- Slide "), (F.col("_p") + 1).cast("string"), dash, F.when(here, " (the slide being read)").otherwise(""), F.lit(" ---")),
    ).otherwise("The full slide, with the translation shown to the student:")
    sections = asked.join(held.hint("merge"), ["deck_id", "_p"]).select(
        *request, "_p", heading.alias("heading"), "lines", F.when(here, dash).alias("_dash")
    )
    # by request alone, as what is joined below is
    grouped = sections.repartition("request_id").groupBy(*request).agg(
        F.array_sort(F.collect_list(F.struct("_p", "heading", "lines"))).alias("_body"), F.max("_dash").alias("_dash")
    )
    number = (F.col("page_index") + 1).cast("string")
    listed = F.array_join(F.transform("wanted", lambda p: (p + 1).cast("string")), ", ")
    chose = F.when(
        F.size("wanted") > 1,
        F.concat(
            F.lit("The student chose slides "), listed,
            F.lit(" as the context for this question; they are reading slide "), number, F.lit("."),
        ),
    )
    known = F.when(F.coalesce("terms", F.lit("")) != "", F.concat(F.lit("\nTerminology established in this course:\n"), "terms"))
    around = scale.salted_join(wanted, terms, ["deck_id"], "request_id").select(
        *request, F.concat(F.lit("Deck: "), "deck_id").alias("_deck"),
        F.concat(F.lit("Slide "), number, F.lit(" of "), F.col("n_pages").cast("string")).alias("_slide"),
        chose.alias("_chose"), known.alias("_known"),
    )
    around = around.repartition("request_id").join(selection.repartition("request_id").hint("merge"), "request_id", "left")
    full = joined_sections(around.hint("merge").join(grouped.hint("merge"), request), "_body")
    return full.select(
        "request_id",
        F.concat_ws("\n", "_deck", F.concat("_slide", "_dash"), "_chose", F.lit(""), "_body", "selection", "_known").alias("context"),
    )


_FRAME = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([T.StructField("delta", T.StructType([T.StructField("content", T.StringType())]))]))),
    T.StructField("usage", T.StructType([T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType())])),
])


def assemble_fragments(frames: DataFrame) -> DataFrame:
    """Streamed lines (message_id, seq, line) put together into messages.

    Only ``data:`` lines before ``[DONE]`` count; a line that is no JSON is skipped; the tokens
    are those of the frame that reports usage.
    """
    bare = tx.strip("line")
    payload = tx.strip(F.substr(bare, F.lit(6)))
    rows = frames.where(bare.startswith("data:")).select("message_id", "seq", payload.alias("_p"))
    read = rows.withColumn("_f", F.from_json("_p", _FRAME)).select(
        "message_id", "seq", (F.col("_p") == "[DONE]").alias("_done"),
        F.get("_f.choices", F.lit(0))["delta"]["content"].alias("content"), F.col("_f.usage").alias("usage"),
    )
    ends = read.where("_done").groupBy("message_id").agg(F.min("seq").alias("_end"))
    # the end mark is applied before anything is gathered; its table is a row a message
    open_ = scale.salted_join(read, ends, ["message_id"], "seq").where(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))

    def joined(order: str, value: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
        return F.array_join(F.transform(parts, lambda p: p[value]), "")

    last = F.max_by(F.when(F.col("usage").isNotNull(), F.col("usage")), F.when(F.col("usage").isNotNull(), F.col("seq")))
    at = F.max(F.when(F.col("usage").isNotNull(), F.col("seq")))
    # first runs of frames, then the runs of a message: no task gathers all frames of a long one
    runs = open_.groupBy("message_id", scale.shard_of("seq").alias("_run")).agg(
        joined("seq", "content").alias("content"), last.alias("usage"), at.alias("seq")
    )
    usage = F.max_by("usage", "seq")
    found = runs.groupBy("message_id").agg(joined("_run", "content").alias("text"), usage.alias("usage"))
    every = read.select("message_id").distinct().join(found, "message_id", "left")  # a message may end at once
    return every.select(
        "message_id", F.coalesce("text", F.lit("")).alias("text"), F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.completion_tokens").alias("completion_tokens"),
    )


def chat_requests(turns: DataFrame, system: Column, context: Column) -> DataFrame:
    """The messages of a model request, one row each: system, context, acknowledgement, the
    earlier turns, and the last turn as the question.

    Rows, not an array, and numbered in shards: a conversation may be of any length.
    """
    numbered = scale.sharded_rank(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", "position", start=3).drop("shard")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    known = scale.salted_join(numbered, last, ["conv_id"], "turn", how="inner")
    history = known.select(
        "conv_id", "position", F.when(F.col("turn") == F.col("_last"), "user").otherwise(F.col("role")).alias("role"),
        F.col("text").alias("content"),
    )
    opening = last.select(
        "conv_id",
        F.posexplode(F.array(
            F.struct(F.lit("system").alias("role"), system.alias("content")),
            F.struct(F.lit("user").alias("role"), context.alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.lit(ACKNOWLEDGEMENT).alias("content")),
        )).alias("position", "_m"),
    ).select("conv_id", F.col("position").cast("bigint").alias("position"), "_m.role", "_m.content")
    return opening.unionByName(history)
