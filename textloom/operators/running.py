"""Numbers along an order within keys, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

#: Rows of a key that one task numbers, about.
ROWS_PER_BUCKET = 8_000


def numbered(df: DataFrame, keys: list[str], by: str, name: str, rows: int) -> DataFrame:
    """df with name: 1, 2, 3 ... within keys in the order of by; rows: how many rows of one key there are at most.

    Ranges of by are numbered by themselves and begin where those before them end, so a key that repeats in many rows is
    many tasks' work. Without such a key this is a window.
    """
    if rows <= ROWS_PER_BUCKET:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(by)).cast("long"))
    # Ranges of (keys, by), so a hot key lies in several; written, as both uses of a row's range must agree.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUCKET) * 2)
    df = written(df.repartitionByRange(parts, *keys, by).withColumn("_part", F.spark_partition_id()), "numbered")
    totals = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_part").orderBy(by)
    numbers = df.withColumn("_at", F.row_number().over(own)).join(totals, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_at"))
    return numbers.drop("_part", "_at", "_before")


def most_of_one(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
