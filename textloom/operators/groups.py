"""Groups: best row, mode, signature, pages inside a group, multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark prunes the sort to it."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def mode(df: DataFrame, keys: list[str], value: str, counted: str, tie: Column) -> DataFrame:
    """The value with most distinct counted of each key; ties go to the least tie."""
    counts = df.groupBy(*keys, value).agg(F.count_distinct(counted).alias("n"))
    return top(counts, keys, [F.desc("n"), tie, F.asc(value)])


def first_wins(parts: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """The union of parts; of rows with one key the one from the earliest part stands (column priority)."""
    every = None
    for i, part in enumerate(parts):
        part = part.withColumn("priority", F.lit(i))
        every = part if every is None else every.unionByName(part)
    return top(every, [key], [F.asc("priority"), *order])


def signature(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """SHA-1 of item:count in the order of items: the same for the same multiset."""
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), "n")))
    return counts.groupBy(*keys).agg(F.sha1(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["i"], x["n"])), "|").cast("binary")).alias("signature"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest_of_tag(df: DataFrame, time: str, key: str, tag: str) -> DataFrame:
    """A history's last row of each tag, where rows without one carry the tag before them.

    A day is a task's; the last tag of each day, a row a day, tells what the days after it begin with.
    """
    df = df.withColumn("_day", F.to_date(time))
    days = df.groupBy("_day").agg(F.max_by(tag, F.when(F.col(tag).isNotNull(), F.struct(time, key))).alias("_last"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    own = F.last(tag, ignorenulls=True).over(Window.partitionBy("_day").orderBy(time, key).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn(tag, own).join(days, "_day").withColumn(tag, F.coalesce(tag, "_carried")).where(F.col(tag).isNotNull()).drop("_day", "_carried")
    others = [c for c in rows.columns if c != tag]
    best = rows.groupBy(tag).agg(F.max_by(F.struct(*others), F.struct(time, key)).alias("_best"))
    return best.select(tag, "_best.*")


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a without those of b, each taking away one."""
    return a.exceptAll(b)
