"""What the training-data operators share: written tables, running totals, joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scratch import shared_dir, written

__all__ = ["shared_dir", "written"]

#: ASCII letters for translate(), which leaves every other letter as it is.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that one task ranks at most; buckets are added as the input grows.
ROWS_PER_BUCKET = 8_000


_kept: dict[object, object] = {}


def kept(key: object, build):
    """What a worker builds once and uses for all its tasks of one kind; a task of another kind makes room first.

    Workers live on from stage to stage, so an earlier operator's tables must not stay in them.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_rows(docs: DataFrame) -> DataFrame:
    """doc_id and text only (null: empty), so that further columns, whatever their names, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(remainder: int) -> Column:
    """crc32(doc_id as text) mod 5 equals remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_BUCKET))


def numbered(df: DataFrame, keys: list[str], by: str, buckets: int | Column, name: str) -> DataFrame:
    """Add name: 0, 1, 2 ... within keys, without ever sorting a whole key in one task."""
    return running_total(df, keys, by, F.lit(1), buckets, name)


def running_total(df: DataFrame, keys: list[str], by: str, weight: Column, buckets: int | Column, name: str) -> DataFrame:
    """Add name: the sum of weight over the rows before each, within keys.

    by is a column that tells rows apart. Rows are dealt into buckets by a hash of it; each bucket is added up by itself
    and starts where the buckets before it end. The totals are one row for each key and bucket.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(buckets) if isinstance(buckets, int) else buckets)).withColumn("_w", weight)
    own = Window.partitionBy(*keys, "_bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        df.withColumn("_at", F.coalesce(F.sum("_w").over(own), F.lit(0)))
        .join(totals, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
        .drop("_bucket", "_w", "_at", "_before")
    )


def joined_by_share(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of keyed (a row for each key, null a key as well, with the count of its rows).

    Keys that hold a thousandth of all rows or more are a thousand at most, so they are broadcast; the rest is shuffled,
    where no key is more than a thousandth.
    """
    hot = F.col(count) * 1000 >= total
    many, few = (F.broadcast(keyed.where(hot)), keyed.where(~hot))
    named = lambda d: d.withColumnRenamed(key, "_key").withColumn("_held", F.lit(True))
    found = rows.join(named(many), F.col(key).eqNullSafe(F.col("_key")), "left")
    added = [c for c in keyed.columns if c != key]
    rest = found.where("_held is null").select(*rows.columns)
    # Rows of the broadcast keys are told by _held; all others find theirs by a shuffle.
    rest = rest.join(named(few), F.col(key).eqNullSafe(F.col("_key")), "inner")
    return found.where("_held").select(*rows.columns, *added).unionByName(rest.select(*rows.columns, *added))
