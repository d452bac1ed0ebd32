"""Memory, replies, calls, prices, catalog, glossary and requests derived from the source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import catalog as cat
from quire.operators import memory as mem
from quire.operators import model
from quire.sources import views
from quire.sources.corpus import table
from quire.sources.views import MODEL, PAGE, TARGET_LANG

EPOCH = 1_704_067_200  # 2024-01-01 00:00 UTC


def cache(sentences: DataFrame) -> DataFrame:
    """What the memory holds: sentences by the first digit of their id, some with an empty entry."""
    texts = sentences.where(F.ascii("sentence_id") % 3 == 0).select("text", "sentence_id").distinct()
    second = F.substring("sentence_id", 2, 1)
    translation = F.when(second == "0", "").otherwise(F.concat(F.lit("«"), F.col("text"), F.lit("»")))
    return texts.select(
        tx.cache_key("text", TARGET_LANG, MODEL).alias("cache_key"), F.col("text").alias("source"),
        translation.alias("translation"), (F.ascii(second) + 1000).cast("bigint").alias("updated_at"),
    )


def keyed_sentences(sentences: DataFrame) -> DataFrame:
    return mem.with_cache_key(sentences, TARGET_LANG, MODEL)


def translated(sentences: DataFrame) -> DataFrame:
    """Sentences with what the memory gives them, some of it flagged."""
    looked = mem.cache_lookup(keyed_sentences(sentences), cache(sentences))
    odd = (F.col("block_index") + F.col("sent_index") + F.col("page_index")) % 10 == 0
    return looked.withColumn("flagged", odd & F.col("translation").isNotNull())


def translations(sentences: DataFrame) -> DataFrame:
    """What the memory gives sentences that are worth translating, by their place, where it gives anything.
    Keys are dealt out, not texts."""
    place = ["deck_id", "page_index", "block_index", "sent_index"]
    keys = keyed_sentences(sentences.where(model.worth_translating())).select(*place, "cache_key")
    return mem.cache_lookup(keys, cache(sentences)).where("translation IS NOT NULL").select(*place, "translation")


def pending(sentences: DataFrame) -> DataFrame:
    return mem.pending_units(keyed_sentences(sentences), cache(sentences))


def replies(units: DataFrame) -> DataFrame:
    """Three rounds of model replies per page as raw text, with the usual deviations."""
    page, a = F.col("page_index"), F.col("attempt")
    rows = units.groupBy(*PAGE).agg(F.collect_list(F.struct("unit_id", "text")).alias("_u"))
    rows = rows.withColumn("attempt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))

    def given(u: Column) -> Column:
        n = u["unit_id"]
        return ((n + page + a) % 4 != 0) & ((n * 7 + page) % 23 != 0)

    def answer(u: Column) -> Column:
        m = u["unit_id"] + page
        return (
            F.when(m % 17 == 0, "").when(m % 13 == 0, u["text"])
            .when(m % 19 == 0, F.repeat(F.lit("x"), (4 * F.length(u["text"]) + 61).cast("int")))
            .otherwise(F.concat(F.lit("«"), u["text"], F.lit("»"), a.cast("string")))
        )

    def key(u: Column) -> Column:
        n = u["unit_id"].cast("string")
        return F.when(page % 3 == 0, F.concat(F.lit("["), n, F.lit("]"))).otherwise(n)

    entries = F.transform(F.filter("_u", given), lambda u: F.struct(key(u).alias("key"), answer(u).alias("value")))
    strays = F.array(
        F.struct(F.lit("99999").alias("key"), F.lit("stray").alias("value")),
        F.struct(F.lit("x7").alias("key"), F.lit("no number").alias("value")),
    )
    terms = F.create_map(
        F.concat(F.lit("Term"), (page % 50).cast("string")), F.concat(F.lit("t"), page.cast("string")),
        F.lit("blank"), F.lit(""),
    )
    body = F.to_json(F.struct(F.map_from_entries(F.concat(entries, strays)).alias("units"), terms.alias("glossary")))
    text = (
        F.when((page % 11 == 5) & (a == 1), "not json")
        .when((page % 29 == 7) & (a == 0), '{"units": ')
        .when(page % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return rows.select(*PAGE, "attempt", text.alias("reply"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """One model call per assistant turn; the prompt is the user turn before it."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.length("text").alias("_p"))
    rows = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"], "left")
    which = F.col("conv_id") % 6

    def pick(*names: str) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (which + 1).cast("int"))

    prompt = F.coalesce("_p", F.lit(0)).cast("bigint")
    seconds = F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * 60
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("call_id"), "conv_id",
        F.timestamp_seconds(seconds).alias("ts"),
        pick("deepseek", "openai", "moonshot", "siliconflow", "ollama", "siliconflow").alias("provider"),
        pick("m0", "m1", "m2", "m3", "m4", "m5").alias("model"),
        F.element_at(F.array(F.lit("translate"), F.lit("ask"), F.lit("pricing")), (F.col("turn") % 3 + 1).cast("int")).alias("kind"),
        prompt.alias("prompt"), F.floor(prompt / 3).cast("bigint").alias("cached"),
        F.length("text").cast("bigint").alias("completion"),
    )


PRICES_DDL = (
    "provider string, model string, input double, cached_input double, output double, currency string, "
    "peak_multiplier double"
)


def prices(spark: SparkSession) -> DataFrame:
    """The price list in force; a null is left to the defaults."""
    rows = [
        ("deepseek", "m0", 2.0, 0.2, 8.0, "CNY", 2.0),
        ("openai", "m1", 1.25, 0.125, 10.0, None, None),
        ("moonshot", "m2", 4.0, None, 16.0, None, 1.0),
        ("siliconflow", "m5", 1.0, 0.5, 2.0, "EUR", 1.0),
    ]
    return spark.createDataFrame(rows, PRICES_DDL)


def fx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("USD", 7.1)], "currency string, rate double")


def price_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Published price rows, one per part: provider, model, prices, when and where read."""
    p = table(spark, sf, "part")
    n = F.col("p_partkey")
    return p.select(
        F.lower("p_brand").alias("provider"), F.concat(F.lit("m"), (n % 97).cast("string")).alias("model"),
        F.round(F.col("p_retailprice") / 100, 4).alias("input"),
        F.when(n % 3 != 0, F.round(F.col("p_retailprice") / 1000, 4)).alias("cached_input"),
        F.round(F.col("p_retailprice") / 50, 4).alias("output"),
        (F.lit(EPOCH) + F.col("p_size").cast("bigint") * 86400 + n % 1000).cast("bigint").alias("updated_at"),
        F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.com")).alias("source"),
        F.when(n % 4 == 0, "").otherwise(F.col("p_name")).alias("note"), n.alias("feed_id"),
    )


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Library paths from page addresses: host, folders, and a file name with an ending."""
    pages = table(spark, sf, "pages")
    n = F.col("page_id")
    bare = tx.replace_all(tx.replace_all("url", r"\A[a-z]+://"), r"[?#].*\z")
    bare = tx.replace_all(bare, r"/+\z")
    ending = F.element_at(
        F.array(*[F.lit(e) for e in (".html", ".pdf", ".PPTX", ".md", ".docx", ".zip")]), (F.length("html") % 6 + 1).cast("int")
    )
    folder, name = tx.replace_all(bare, r"/[^/]*\z"), F.element_at(F.split(bare, "/"), -1)
    name = F.when(name.contains("."), name).otherwise(F.concat(name, ending))
    name = F.when(n % 50 == 0, F.concat(F.lit("."), name)).otherwise(name)
    folder = F.when(n % 60 == 7, F.concat(folder, F.lit("/.trash"))).otherwise(folder)
    return cat.path_catalog(pages.select("page_id", F.concat(folder, F.lit("/"), name).alias("path")))


def glossary(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the page titles, of some pages every two neighbouring words, as terms at a level of
    the page's folder chain."""
    title = tx.fold_case(F.regexp_extract("html", r"<title>([^<]*)", 1))
    words = F.filter(F.split(title, r"[^\p{L}]+"), lambda w: w != "")
    n = F.col("page_id")
    pairs = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    titled = table(spark, sf, "pages").select("page_id", F.explode(F.when(n % 4 == 0, pairs).otherwise(words)).alias("term"))
    rows = titled.join(catalog(spark, sf).select("page_id", "folder"), "page_id").where("term <> ''")
    level = F.slice(F.split("folder", "/"), 1, (n % 3).cast("int"))
    return (
        rows.withColumn("scope", F.array_join(level, "/"))
        .groupBy("scope", "term")
        .agg(
            F.min_by(F.concat(F.lit("tr:"), F.col("term"), F.lit(":"), n.cast("string")), n).alias("translation"),
            F.bool_or(n % 11 == 0).alias("locked"), F.count(F.lit(1)).alias("count"),
        )
    )


def proposing(spark: SparkSession, sf: str) -> DataFrame:
    """The documents whose words a model offered as terms."""
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("deck_id"), "text")


def proposals_of(docs: DataFrame) -> DataFrame:
    """Terms a model offered: every word of every line of the documents, in order. ``seq`` holds the
    document in its upper half and the word's number in its lower one. Other columns go with the words."""
    words = F.flatten(F.transform(views.text_lines("text"), lambda s: F.split(s, " ")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # a plain explode would work the words out twice, once to see that there are any
    found = docs.select("doc_id", *others, F.posexplode_outer(words).alias("k", "term")).where("k IS NOT NULL")
    mark = F.col("doc_id") + F.col("k")
    return found.select(
        *others, (F.shiftleft("doc_id", 32) + F.col("k")).alias("seq"), "term",
        F.when(mark % 10 == 0, " ").otherwise(F.concat(F.lit(" p:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("k").cast("string"))).alias("translation"),
    )


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    return proposals_of(proposing(spark, sf))


def deck_homes(spark: SparkSession, sf: str) -> DataFrame:
    """The folder a deck lies in: that of the page with the deck's number."""
    decks = views.deck_sizes(spark, sf).withColumn("page_id", F.regexp_extract("deck_id", r"(\d+)\z", 1).cast("bigint"))
    return decks.join(catalog(spark, sf).select("page_id", "folder"), "page_id").select("deck_id", "folder")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One question per page, with pages picked as its context: some twice, some out of range."""
    pages = views.paged_documents(spark, sf).select(*PAGE, "doc_id")
    doc, page = F.col("doc_id"), F.col("page_index")
    last = F.when(doc % 97 == 0, F.lit(29)).otherwise(doc % 4)
    picked = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: (page * 7 + i * 3) % (page + 40) - 2)
    return pages.select(*PAGE, doc.alias("request_id"), picked.alias("picked"))
