"""Queries over indexes that last, and over texts without spaces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import segment
from ..operators.fulltext import FullTextIndex, IndexConfig
from ..operators.scratch import shared_dir
from ..sources.catalog import TEXT_MAP, Catalog
from .queries import FOLDED, query

WORDS = rf"list_filter(string_split_regex({FOLDED}, '\s+'), lambda x: x <> '')"
BEFORE = "before AS (SELECT doc_id AS hash, lang, CASE WHEN n_chars % 9 = 0 THEN text || ' the und' ELSE text END AS content FROM documents WHERE source <> 'src5')"
AFTER = "after AS (SELECT doc_id AS hash, lang, text AS content FROM documents)"


def _index(c: Catalog, config: IndexConfig) -> FullTextIndex:
    return FullTextIndex(c.spark, f"{shared_dir(c.spark)}/textloom/fulltext-{uuid.uuid4().hex}", config)


def _texts(c: Catalog) -> DataFrame:
    return c.text_map().select("lang", "hash", "content")


@query(rf"WITH {TEXT_MAP}, w AS (SELECT hash, lang, {WORDS} AS words FROM text_map) SELECT lang, hash FROM w WHERE lang = 'en' AND list_contains(words, 'the') AND list_contains(words, 'with') AND list_contains(words, 'was')")
def fts_index_all_terms(c: Catalog) -> DataFrame:
    """All terms, by the posting lists of an index that has been built."""
    index = _index(c, IndexConfig(("en", "de")))
    index.ensure(_texts(c))
    return index.find(_texts(c), "“the with Was”", "en")


@query(
    rf"WITH {TEXT_MAP}, w AS (SELECT hash, lang, {WORDS} AS words FROM text_map WHERE lang IN ('en', 'de', 'fr')), "
    "p AS (SELECT hash, lang, words, unnest(range(1, len(words))) AS i FROM w) "
    "SELECT lang, hash, (min(i) - 1)::INT AS first, count(*) AS n FROM p WHERE words[i] = 'of' AND words[i + 1] = 'the' GROUP BY lang, hash"
)
def fts_index_phrase(c: Catalog) -> DataFrame:
    """Texts in which terms follow one another, by their places."""
    index = _index(c, IndexConfig(("en", "de", "fr")))
    index.ensure(_texts(c))
    return index.phrase(["of", "the"]).select("lang", "hash", F.col("at").cast("int").alias("first"), "n")


@query(rf"WITH {AFTER}, w AS (SELECT hash, lang, {WORDS} AS words FROM after) SELECT lang, hash FROM w WHERE lang IN ('en', 'de', 'es') AND list_contains(words, 'the') AND list_contains(words, 'und')")
def fts_index_refreshed(c: Catalog) -> DataFrame:
    """An index of earlier texts that follows new, changed and lost ones, and is then one generation again."""
    texts = c.table("documents").select("lang", F.col("doc_id").alias("hash"), F.col("text").alias("content"), "source", "n_chars")
    marked = F.when(F.col("n_chars") % 9 == 0, F.concat("content", F.lit(" the und"))).otherwise(F.col("content"))
    before = texts.where("source <> 'src5'").select("lang", "hash", marked.alias("content"))
    index = _index(c, IndexConfig(("en", "de", "es")))
    index.build(before)
    index.refresh(before, texts.select("lang", "hash", "content"))
    index.compact()
    return index.every(["the", "und"])


@query(rf"WITH {BEFORE}, w AS (SELECT hash, lang, regexp_replace(content, '\s+', '', 'g') AS whole FROM before) SELECT lang, hash FROM w WHERE lang = 'fr' AND contains(whole, 'le') AND contains(whole, 'eq') AND contains(whole, 'qu')")
def fts_index_pairs(c: Catalog) -> DataFrame:
    """A language without spaces, after a change of configuration has made the index anew, and texts were taken away."""
    texts = c.table("documents").select("lang", F.col("doc_id").alias("hash"), F.col("text").alias("content"), "source", "n_chars")
    marked = F.when(F.col("n_chars") % 9 == 0, F.concat("content", F.lit(" the und"))).otherwise(F.col("content"))
    before = texts.where("source <> 'src5'").select("lang", "hash", marked.alias("content"))
    first = _index(c, IndexConfig(("fr",)))
    first.build(texts.limit(0).select("lang", "hash", "content"))
    index = FullTextIndex(c.spark, first.path, IndexConfig(("fr",), pairs=("fr",)))
    index.ensure(texts.select("lang", "hash", "content"))
    index.refresh(texts.select("lang", "hash", "content"), before)
    return index.find(before, "l equ", "fr")


@query(rf"WITH {TEXT_MAP}, w AS (SELECT hash, lang, {WORDS} AS words FROM text_map) SELECT lang, hash FROM w WHERE lang = 'es' AND list_contains(words, 'de') AND list_contains(words, 'la')")
def fts_language_gate(c: Catalog) -> DataFrame:
    """A language that the index does not hold is searched by scanning."""
    index = _index(c, IndexConfig(("en",)))
    index.ensure(_texts(c).where("lang = 'en'"))
    return index.find(_texts(c), "de la", "es")


# Names whose words are in the dictionary: paths through words and single characters, the best by the product of shares,
# of equal ones the one with longer words first.
@query(
    "WITH RECURSIVE d AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part UNION ALL SELECT unnest(['sma', 'llr', 'ing', 'red', 'dwid', 'get', 'hot', 'hotg', 'ear', 'in', 'g'])) GROUP BY word), "
    "t AS (SELECT sum(n) AS total FROM d), names AS (SELECT DISTINCT replace(p_name, ' ', '') AS name FROM part), "
    "u AS (SELECT word, n FROM d UNION ALL SELECT DISTINCT substr(name, i, 1), 1 FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM names) WHERE substr(name, i, 1) NOT IN (SELECT word FROM d)), "
    "p(name, rest, words, sizes, score) AS (SELECT name, name, ''::VARCHAR, ''::VARCHAR, 0.0::DOUBLE FROM names UNION ALL "
    "SELECT name, substr(rest, length(word) + 1), words || '/' || word, sizes || chr(65 + length(word)::INT), score + ln(n::DOUBLE) - ln(total::DOUBLE) FROM p JOIN u ON starts_with(rest, word), t WHERE rest <> ''), "
    "b AS (SELECT name, words FROM p WHERE rest = '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, sizes DESC) = 1) "
    "SELECT p_partkey, substr(words, 2) AS words FROM part JOIN b ON b.name = replace(p_name, ' ', '')"
)
def segmented_names(c: Catalog) -> DataFrame:
    """Names without their spaces, split by a dictionary that a table holds; other words compete with the right ones."""
    rivals = c.spark.createDataFrame([(w,) for w in ("sma", "llr", "ing", "red", "dwid", "get", "hot", "hotg", "ear", "in", "g")], "word string")
    parts = c.table("part")
    dictionary = parts.select(F.explode(F.split("p_name", " ")).alias("word")).unionByName(rivals).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return parts.select("p_partkey", F.array_join(segment.words(F.replace("p_name", F.lit(" "), F.lit("")), dictionary), "/").alias("words"))


@query(None)
def segmented_texts(c: Catalog) -> DataFrame:
    """Whole texts without their spaces, as index terms by the words of the benchmark's texts."""
    each = c.table("benchmark").select(F.explode(F.split(text.fold(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("word"))
    dictionary = each.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = c.table("documents").select("doc_id", segment.terms(text.fold(F.col("text")), dictionary).alias("terms"))
    return found.select("doc_id", F.size("terms").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("terms_sha256"))
