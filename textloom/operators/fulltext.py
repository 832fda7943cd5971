"""A full-text index that lasts: posting lists in buckets of terms, kept up to date by generations.

A folder holds generations of postings, generations of rows that are gone, and a log with a row for each generation that is
complete; what has no row in the log is not read. A posting list is the places of a term in a text, each as the distance
from the one before. A search reads the buckets of its terms alone. A changed configuration has another signature and makes
a rebuild; a changed row is a dead row and a new one, so an update costs what changed.

Terms are the words between blanks, for languages written without spaces pairs of characters or, with a dictionary, the
words of the best segmentation. Languages that are not in the index, and folders without a usable index, are searched by
scanning the texts, with the same result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

KEYS = ["lang", "hash"]
#: Words that a task makes lists of at a time, about.
WORDS_AT_ONCE = 1_000_000
LOG = "generation long, signature string, langs array<string>, terms long"


@dataclass(frozen=True)
class IndexConfig:
    langs: tuple[str, ...]
    #: Languages without spaces between words.
    pairs: tuple[str, ...] = ()
    buckets: int = 32

    def signature(self) -> str:
        return hashlib.sha1(json.dumps([sorted(set(self.langs)), sorted(set(self.pairs)), self.buckets]).encode()).hexdigest()


def words(c: Column) -> Column:
    """Every word of a text in turn, capitals folded."""
    return F.filter(F.split(text.fold(c), r"\s+"), lambda x: x != "")


def pairs(c: Column) -> Column:
    """Every pair of neighbouring characters in turn; a single character is its own term."""
    whole = text.compact(c)
    return F.filter(F.when(F.length(whole) > 1, text.every_run(whole, 2)).otherwise(F.array(whole)), lambda x: x != "")


def bucket(term: Column, config: IndexConfig) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(config.buckets)).cast("int")


def postings_of(texts: DataFrame, config: IndexConfig) -> DataFrame:
    """(bucket, term, lang, hash, n, deltas) of texts (lang, hash, content) in the languages of the index."""
    rows = texts.where(F.col("lang").isin(*config.langs)).select(*KEYS, F.coalesce("content", F.lit("")).alias("content"))
    terms = words(F.col("content"))
    if config.pairs:
        terms = F.when(F.col("lang").isin(*config.pairs), pairs(F.col("content"))).otherwise(terms)
    listed = rows.select("lang", F.col("hash").cast("long").alias("hash"), terms.alias("terms")).mapInArrow(lists_of, "term string, lang string, hash long, n int, deltas array<int>")
    return listed.select(bucket(F.col("term"), config).alias("bucket"), "term", *KEYS, "n", "deltas")


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, lang, hash, n, deltas) of (lang, hash, terms): a text's lists come from itself, so no word is shuffled."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch["terms"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + WORDS_AT_ONCE, "right")))
            part, own = batch.slice(at, stop - at), sizes[at:stop]
            words = part["terms"].flatten().dictionary_encode()
            row = np.repeat(np.arange(len(own)), own)
            place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
            key = row * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            first = np.flatnonzero(new)
            deltas = place - np.where(new, 0, np.roll(place, 1))
            which, edges = order[first], np.append(first, len(key)).astype(np.int32)
            columns = [words.dictionary.take(words.indices.take(pa.array(which))), part["lang"].take(pa.array(row[which])), part["hash"].take(pa.array(row[which]))]
            columns += [pa.array(np.diff(edges), pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pa.array(deltas, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["term", *KEYS, "n", "deltas"])
            at = stop


class FullTextIndex:
    def __init__(self, spark: SparkSession, path: str, config: IndexConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config

    # What the folder holds

    def log(self) -> list:
        """The complete generations of this configuration since its last build, oldest first; none where there is no index."""
        try:
            rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("generation").collect()
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return []
        own: list = []
        for row in rows:  # a row for each generation since the last compaction
            if row.terms >= 0:
                own = own + [row] if own and own[-1].signature == row.signature else [row]
            else:
                own = []
        return own if own and own[-1].signature == self.config.signature() else []

    def _next(self) -> int:
        try:
            return (self.spark.read.schema(LOG).parquet(f"{self.path}/log").agg(F.max("generation")).first()[0] or 0) + 1
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return 1

    def _commit(self, generation: int, terms: int) -> None:
        row = [(generation, self.config.signature(), sorted(set(self.config.langs)), terms)]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, postings: DataFrame, generation: int) -> int:
        out = f"{self.path}/postings/generation={generation}"
        # Each task writes what its texts have, in the order of terms: a frequent term is not one task's, and nothing is dealt anew.
        postings.sortWithinPartitions("bucket", "term", *KEYS).write.mode("overwrite").partitionBy("bucket").parquet(out)
        self.spark.createDataFrame([], "lang string, hash long").write.mode("overwrite").parquet(f"{self.path}/dead/generation={generation}")
        return self._lists([generation]).count()

    def _lists(self, generations: list[int]) -> DataFrame:
        schema = "term string, lang string, hash long, n int, deltas array<int>, generation long, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/postings").parquet(*(f"{self.path}/postings/generation={g}" for g in generations))

    # Build and upkeep

    def needs_rebuild(self, texts: DataFrame) -> bool:
        """No complete index of this configuration; or one without any posting though there are texts."""
        log = self.log()
        return not log or (sum(r.terms for r in log) == 0 and not texts.where(F.col("lang").isin(*self.config.langs)).isEmpty())

    def build(self, texts: DataFrame) -> None:
        generation = self._next()
        # A row that ends the generations before: nothing of them is read any more.
        self.spark.createDataFrame([(generation, self.config.signature(), [], -1)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        self._commit(generation + 1, self._write(postings_of(texts, self.config), generation + 1))

    def ensure(self, texts: DataFrame) -> bool:
        """Build where needed; whether it was."""
        needed = self.needs_rebuild(texts)
        if needed:
            self.build(texts)
        return needed

    def refresh(self, before: DataFrame, after: DataFrame) -> None:
        """Follow the texts from before to after (lang, hash, content): a generation of what changed."""
        if not self.log():
            return self.build(after)
        # Digests tell what changed; only the texts that did are read again.
        side = lambda d, name: d.select(*KEYS, F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias(name), F.lit(True).alias(f"has_{name}"))
        both = side(before, "old").join(side(after, "new"), KEYS, "full").where(~F.col("old").eqNullSafe(F.col("new")))
        generation = self._next()
        gone = both.where(F.col("has_old") & F.col("lang").isin(*self.config.langs))
        come = after.join(both.where("has_new").select(*KEYS), KEYS, "left_semi")
        terms = self._write(postings_of(come, self.config), generation)
        gone.select(*KEYS).write.mode("overwrite").parquet(f"{self.path}/dead/generation={generation}")
        self._commit(generation, terms)

    def compact(self) -> None:
        """One generation of all live postings."""
        log = self.log()
        if len(log) > 1:
            live = self._live(self._lists([r.generation for r in log]), log)
            generation = self._next()
            terms = self._write(live.select("bucket", "term", *KEYS, "n", "deltas"), generation + 1)
            self.spark.createDataFrame([(generation, self.config.signature(), [], -1)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
            self._commit(generation + 1, terms)

    def _live(self, lists: DataFrame, log: list) -> DataFrame:
        """Without the postings of rows that a later generation, or their own, has taken away before it was written."""
        if len(log) == 1:
            return lists
        dead = self.spark.read.schema("lang string, hash long, generation long").option("basePath", f"{self.path}/dead").parquet(*(f"{self.path}/dead/generation={r.generation}" for r in log))
        last = dead.groupBy(*KEYS).agg(F.max("generation").alias("died"))
        return lists.join(last, KEYS, "left").where(F.col("died").isNull() | (F.col("generation") >= F.col("died"))).drop("died")

    # Search

    def lists(self, terms: list[str]) -> DataFrame:
        """The live posting lists of terms: only their buckets are read."""
        log = self.log()
        wanted = self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"), self.config).alias("b")).distinct()
        buckets = [r.b for r in wanted.collect()]  # as many as the query has terms
        return self._live(self._lists([r.generation for r in log]).where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)), log)

    def every(self, terms: list[str]) -> DataFrame:
        """(lang, hash) of the texts that hold all terms."""
        terms = list(dict.fromkeys(terms))
        return self.lists(terms).groupBy(*KEYS).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(terms)).select(*KEYS)

    def phrase(self, terms: list[str]) -> DataFrame:
        """(lang, hash, at, n): texts in which terms follow one another, the first such place and how many there are."""
        found = self.lists(list(dict.fromkeys(terms)))
        at = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(terms)))
        # Each place of a term, less the term's own place in the phrase, is where the phrase would begin.
        wanted = F.filter(at, lambda x: x["term"] == F.col("term"))
        each = found.withColumn("list", F.monotonically_increasing_id()).select("list", *KEYS, "term", F.posexplode("deltas").alias("k", "delta"))
        # Rows that repeat a key have a list each.
        upto = Window.partitionBy("list").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        starts = each.withColumn("place", F.sum("delta").over(upto)).select(*KEYS, "place", F.explode(wanted).alias("w")).select(*KEYS, "w.i", "place")
        hits = starts.groupBy(*KEYS, (F.col("place") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("n")).where(F.col("n") == len(terms))
        return hits.groupBy(*KEYS).agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))

    def find(self, texts: DataFrame, keyword: str, lang: str, stop: tuple[str, ...] = ()) -> DataFrame:
        """(lang, hash) of the texts of a language that hold all terms of a keyword: by the index where it serves the
        language, else by scanning texts."""
        spaced = lang not in self.config.pairs
        terms = text.query_terms(keyword, words=spaced, stop=stop)
        own = texts.where(F.col("lang") == lang)
        if not terms:
            return own.select(*KEYS).limit(0)
        if lang in self.config.langs and self.log():
            return self.every(terms).where(F.col("lang") == lang)
        held = words(F.col("content")) if spaced else pairs(F.col("content"))
        return own.where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains(held, t))).select(*KEYS)
