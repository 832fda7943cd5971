"""Keyword search: match, rank, page. Every order is total, and counts are those of what is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, versions


def matches(texts: DataFrame, word: str, lang: str | None = None, subsequence: bool = False) -> DataFrame:
    found = texts.where(text.like_any(F.col("content"), text.keyword(word), subsequence))
    return found.where(F.col("lang") == lang) if lang else found


def with_flag(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """df with a boolean: whether ids (one column, distinct) holds its key."""
    ids = ids.select(F.col(ids.columns[0]).alias("_id"), F.lit(True).alias("_held"))
    return df.join(ids, F.col(key) == F.col("_id"), "left").withColumn(name, F.coalesce("_held", F.lit(False))).drop("_id", "_held")


def by_version(texts: DataFrame, dim: DataFrame, created: str | None = None, updated: str | None = None) -> DataFrame:
    """Texts created in a version; or updated in one, unless that is the one they were created in. dim is one row for each version."""
    side = lambda p: dim.select(F.col("id").alias(f"_{p}"), versions.label(F.col("version_tag"), F.col("raw_version")).alias(f"{p}_label"))
    df = texts.join(side("created"), F.col("created_version_id") == F.col("_created"), "left").join(side("updated"), F.col("updated_version_id") == F.col("_updated"), "left")
    if created is not None:
        df = df.where(F.col("created_label") == created.strip().lower())
    if updated is not None:
        df = df.where((F.col("updated_label") == updated.strip().lower()) & ~F.col("created_label").eqNullSafe(F.col("updated_label")))
    return df.drop("_created", "_updated")


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """A page of a total order; numbers and sizes below 1 are 1 and 50."""
    number, size = max(1, number), size if size >= 1 else 50
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def clamp(number: int, total: int, size: int) -> int:
    """The last page where a number lies beyond it."""
    return max(1, min(number, -(-total // size) or 1))


def best_field(fields: list[Column], word: str) -> Column:
    """The best (tier, field, length) over several fields."""
    return F.array_min(F.array(*(F.struct(text.tier(c, word).alias("tier"), F.lit(i).alias("field"), F.length(text.norm(c)).alias("length")) for i, c in enumerate(fields))))
