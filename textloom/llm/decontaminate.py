"""Operator 6: benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every run of ten words of a benchmark item is a window (a shorter item is one window). To hold a window a document must
hold all its words, so one necessary word is enough as the prefix: the rarest one, by its count in the documents. Words
of documents are joined with those prefix words alone; length and position bounds follow from the word's place in the
window, and what is left is verified word by word against the document. Scan, words, join and verification are one
generated stage: nothing but true hits is shuffled.

The windows are broadcast while they take BROADCAST_BYTES at most, a bound that is checked first; beyond it places and
words of documents are shuffled to the prefix words, and only what fits a window's place meets its text again.

Defined results: null and empty texts have no words; very long texts are whole; rows that repeat, with or without a doc_id,
are reported each; items with equal windows are all found; an item without an id hits words but is not counted among the
items; an empty benchmark or empty documents leave nothing
contaminated; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW = 10
#: Bytes of windows and of their item ids, and so many more for each window, that are broadcast at most.
BROADCAST_BYTES, WINDOW_BYTES = 64_000_000, 64
#: What parts words, after A-Z are lower case.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Not a word: stands after the last word of each document, so that each document is found once at least.
END = "\n"


def word_list(text: Column) -> Column:
    """Lower-case words; the first and the last may be empty, which no word equals."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), common.UPPER, common.LOWER), APART)


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(words, items): distinct windows and the ids of the items that have them."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.filter(word_list(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def counts_in(docs: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(word, n): how often the documents hold each word of the vocabulary."""
    words = docs.select(F.explode(word_list(F.col("text"))).alias("word"))
    found = words.join(F.broadcast(vocabulary) if small else vocabulary, "word")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def prefixes(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, bool]:
    """(word, skip, words, items): each window under its rarest word, skip words in; and whether they are few enough to broadcast."""
    wins = common.written(windows(benchmark, size), "leak-windows")
    length = lambda name: F.octet_length(F.array_join(name, " ")) + 8 * F.size(name)
    size_of = wins.agg(F.coalesce(F.sum(length("words") + length("items") + WINDOW_BYTES), F.lit(0))).first()[0]
    small = size_of <= BROADCAST_BYTES
    places = wins.select("words", "items", F.posexplode("words").alias("skip", "word"))
    counts = counts_in(docs, places.select("word").distinct(), small)
    rare = places.join(counts, "word", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "skip")).alias("best"), F.first("items").alias("items")
    )
    # A window with a word that no document holds can occur nowhere.
    rare = rare.where("best.n > 0").select("best.word", "best.skip", "words", "items")
    return common.written(rare, "leak-prefixes"), small


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """(rid, key, n_words, start, stop, items): true occurrences, in words; and one row without for each document."""
    rare, small = prefixes(docs, benchmark, size)
    end = docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).alias("skip"), F.array(F.lit(END)).alias("words"), F.array().cast("array<string>").alias("items"))
    rare = rare.unionByName(end)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key), F.concat(word_list(F.col("text")), F.array(F.lit(END))).alias("all"))
    words = texts.select("rid", key, "all", F.posexplode("all").alias("at", "word"))
    n = F.size("all")
    long = F.size("words")
    fits = (F.col("at") >= F.col("skip")) & (F.col("at") - F.col("skip") + long <= n)
    if small:
        met = words.join(F.broadcast(rare), "word")
    else:
        texts = common.written(texts, "leak-texts")  # numbered once
        places = texts.select("rid", n.alias("n"), F.posexplode("all").alias("at", "word")).join(rare, "word")
        places = places.where((F.col("at") >= F.col("skip")) & (F.col("at") - F.col("skip") + long <= F.col("n"))).drop("n")
        met = places.join(texts, "rid")
    found = met.where(fits & (F.slice("all", F.when(fits, F.col("at") - F.col("skip") + 1).otherwise(1), long) == F.col("words")))
    first, last = F.element_at("all", 1) == "", (n > 2) & (F.element_at("all", F.when(n > 2, n - 1).otherwise(1)) == "")
    return found.select(
        "rid",
        key,
        (n - 1 - first.cast("int") - last.cast("int")).cast("long").alias("n_words"),
        F.when(F.col("word") != END, F.col("at") - F.col("skip")).alias("start"),
        F.when(F.col("word") != END, F.col("at") - F.col("skip") + long).alias("stop"),
        "items",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row of docs each: doc_id, n_words, n_hit (words inside any window), items, contaminated."""
    found = hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, size)
    before = Window.partitionBy("rid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0))))
    return (
        found.withColumn("fresh", F.coalesce(fresh, F.lit(0)))
        .groupBy("rid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.sum("fresh").cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
        .select("doc_id", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))
    )


def leaked(docs: DataFrame, benchmark: DataFrame, key: str, size: int = WINDOW) -> DataFrame:
    """The distinct keys (a column of docs beside text) of documents in which a window occurs."""
    return hits(docs, benchmark, size, key).where("start is not null").select(key).distinct()


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
