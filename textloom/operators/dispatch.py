"""One keyword search over texts, readable pages and subtitles, by kind of source and by voice.

Pages and subtitles have no voice, so a search for voiced texts leaves them out. A keyword that is a number also finds the
text of that hash, whatever it says, and lists it first, as long as it passes the same filters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import search

TEXT, PAGE, SUBTITLE = "text", "readable", "subtitle"


@dataclass(frozen=True)
class Corpus:
    #: (hash, lang, content)
    texts: DataFrame
    #: (hash), distinct
    voiced: DataFrame
    #: (hash, source): what kinds of things a text belongs to
    sources: DataFrame
    #: (key, lang, content)
    pages: DataFrame
    #: (key, lang, content)
    subtitles: DataFrame


def _texts(c: Corpus, word: str, lang: str, voice: str | None, source: str | None) -> DataFrame:
    """(kind, key, content, has_voice, is_hash) of texts."""
    own = c.texts.where(F.col("lang") == lang)
    number = text.int_keyword(word)
    is_hash = (F.col("hash") == number) if number is not None else F.lit(False)
    found = own.where(text.like_any(F.col("content"), word) | is_hash)
    if source == "unknown":
        found = found.join(c.sources.select("hash"), "hash", "left_anti")
    elif source not in (None, "textmap"):
        found = found.join(c.sources.where(F.col("source") == source).select("hash"), "hash", "left_semi")
    found = search.with_flag(found, c.voiced, "hash", "has_voice")
    if voice is not None:
        found = found.where(F.col("has_voice") == F.lit(voice == "with"))
    return found.select(F.lit(TEXT).alias("kind"), F.col("hash").cast("string").alias("key"), "content", "has_voice", F.coalesce(is_hash, F.lit(False)).alias("is_hash"))


def find(c: Corpus, keyword: str, lang: str, voice: str | None = None, source: str | None = None) -> DataFrame:
    """(kind, key, tier, has_voice, length, is_hash) of all hits. voice: with, without or None; source: textmap, unknown,
    readable, subtitle, a kind of source, or None for everything."""
    word = text.keyword(keyword)
    if voice not in (None, "with", "without"):
        raise ValueError(f"no such filter: {voice}")
    parts = []
    if source not in (PAGE, SUBTITLE):
        parts.append(_texts(c, word, lang, voice, source))
    if voice != "with" and source in (None, PAGE, SUBTITLE):
        for kind, rows in ((PAGE, c.pages), (SUBTITLE, c.subtitles)):
            if source in (None, kind):
                hits = rows.where((F.col("lang") == lang) & text.like_any(F.col("content"), word))
                parts.append(hits.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "content", F.lit(False).alias("has_voice"), F.lit(False).alias("is_hash")))
    if not parts or not word:
        parts = [_texts(c, word, lang, voice, None).limit(0)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    content = F.col("content")
    return every.select("kind", "key", text.tier(content, word).alias("tier"), "has_voice", F.length(text.norm(content)).alias("length"), "is_hash")


def page(c: Corpus, keyword: str, lang: str, voice: str | None = None, source: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """A page of the hits: the hash itself, then by tier, voice, length, kind and key; a page beyond the last is the last."""
    hits = find(c, keyword, lang, voice, source)
    total = hits.count()
    order = [F.desc("is_hash"), F.asc("tier"), F.desc("has_voice"), F.asc("length"), F.asc("kind"), F.asc("key")]
    return search.page(hits, order, search.clamp(number, total, size), size).withColumn("total", F.lit(total))
