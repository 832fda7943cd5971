"""Things and their texts: what a thing says, field by field, and which things a text belongs to.

links: (source, entity, hash, title_hash, extra, category), extra with the field in its lowest byte and the form in the next.
texts: (hash, lang, content). labels: (source, category, field, label), null source or category for any; the closest counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_language(texts: DataFrame, langs: list[str]) -> DataFrame:
    """(hash, content, lang): each text in the first of the languages that has it, else in the first by name; empty ones are
    none."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, langs)), F.col("lang")), F.lit(0)), F.lit(len(langs) + 1))
    held = texts.where("content <> ''")
    first = F.min(F.struct(rank.alias("rank"), "lang", "content")).alias("_t")
    return held.groupBy("hash").agg(first).select("hash", "_t.content", "_t.lang")


def labelled(links: DataFrame, labels: DataFrame, otherwise: str) -> DataFrame:
    """links with field, form and label."""
    rows = links.withColumn("field", F.col("extra").bitwiseAND(0xFF).cast("int")).withColumn("form", F.shiftright("extra", 8).bitwiseAND(0xFF).cast("int"))
    out = rows
    fits = [(["source", "category", "field"], "source is not null and category is not null"), (["source", "field"], "source is not null and category is null"), (["field"], "source is null and category is null")]
    for i, (keys, which) in enumerate(fits):
        own = labels.where(which).groupBy(*keys).agg(F.min("label").alias(f"_label{i}"))
        out = out.join(F.broadcast(own), keys, "left")  # a registry of names
    return out.select(*rows.columns, F.coalesce("_label0", "_label1", "_label2", F.lit(otherwise)).alias("label"))


def entries(
    links: DataFrame, texts: DataFrame, labels: DataFrame, langs: list[str], otherwise: str = "text", title_as: Callable[[Column], Column] = lambda c: c, content_as: Callable[[Column], Column] = lambda c: c
) -> DataFrame:
    """(source, entity, hash, title, label, form, lang, content): what things say. A text that no language has is left out, a
    title that none has is null.

    title_as and content_as: what is wanted of them. It is made once for each text, so that links, which are many more, carry
    no more than that."""
    own = by_language(texts, langs)
    title = own.select(F.col("hash").alias("title_hash"), title_as(F.col("content")).alias("title"))
    own = own.select("hash", content_as(F.col("content")).alias("content"), "lang")
    rows = labelled(links, labels, otherwise).join(own, "hash").join(title, "title_hash", "left")
    return rows.select("source", "entity", "hash", "title", "label", "form", "lang", "content")


def details(links: DataFrame, texts: DataFrame, langs: list[str], bodies: DataFrame) -> DataFrame:
    """(source, entity, title, n_entries, missing_body): a row for each thing. Its title is that of its first link by extra and
    hash, else its number; bodies (source, entity): things that other sources have a text for."""
    own = by_language(texts, langs)
    first = F.min_by("title_hash", F.struct("extra", "hash", "title_hash")).alias("title_hash")
    things = links.groupBy("source", "entity").agg(first)
    held = links.join(own.select("hash"), "hash", "left_semi").groupBy("source", "entity").agg(F.count(F.lit(1)).alias("_n"))
    other = bodies.select("source", "entity").distinct().withColumn("_body", F.lit(True))
    rows = things.join(held, ["source", "entity"], "left").join(other, ["source", "entity"], "left")
    rows = rows.join(own.select(F.col("hash").alias("title_hash"), F.col("content").alias("_title")), "title_hash", "left")
    n = F.coalesce("_n", F.lit(0))
    return rows.select("source", "entity", F.coalesce("_title", F.col("entity").cast("string")).alias("title"), n.alias("n_entries"), ((n == 0) & F.col("_body").isNull()).alias("missing_body"))


def sources_of(links: DataFrame, hidden: DataFrame) -> DataFrame:
    """(hash, source, entity, n_sources, first): the things that a text belongs to, but those hidden (source, entity), how many
    there are, and whether this one is named first: by source, then number."""
    rows = links.select("hash", "source", "entity").distinct().join(hidden, ["source", "entity"], "left_anti")
    counted = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n_sources"), F.min(F.struct("source", "entity")).alias("_first"))
    joined = rows.join(counted, "hash")
    return joined.select("hash", "source", "entity", "n_sources", (F.struct("source", "entity") == F.col("_first")).alias("first"))
