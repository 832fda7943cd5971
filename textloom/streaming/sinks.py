"""Several tables written by one stream and seen together, and work that goes on where it stopped.

A micro-batch is written to each of its tables under its number; then one row in a commit log makes all of them visible. What
was written without that row is not read, and a batch that comes again replaces its own rows, so a lost driver leaves no half
of a batch behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

LOG = "batch long, tables array<string>"
DONE = "target string, key string"


def _rows(spark: SparkSession, schema: str, path: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def commit(spark: SparkSession, path: str, number: int, tables: dict[str, DataFrame]) -> bool:
    """Write the tables of a batch and make them visible together; False where that has been done before."""
    log = f"{path.rstrip('/')}/_log"
    if not _rows(spark, LOG, log).where(F.col("batch") == number).isEmpty():
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/batch={number}")
    spark.createDataFrame([(number, sorted(tables))], LOG).coalesce(1).write.mode("append").parquet(log)
    return True


def multi_sink(feed: DataFrame, path: str, parts: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str) -> StreamingQuery:
    """Write parts of a feed to a table each. A batch is read once: its rows are kept while its parts are written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            commit(batch.sparkSession, path, number, {name: part(batch) for name, part in parts.items()})
        finally:
            batch.unpersist()

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of a table, with batch, of the batches that are complete."""
    rows = _rows(spark, f"{schema}, batch long", f"{path.rstrip('/')}/{table}")
    done = _rows(spark, LOG, f"{path.rstrip('/')}/_log").where(F.array_contains("tables", table)).select("batch").distinct()
    return rows.join(F.broadcast(done), "batch", "left_semi")  # a row for each batch


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of visible() the last of each key: by batch, then by order."""
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "batch")


def pending(spark: SparkSession, path: str, target: str, keys: list[str]) -> list[str]:
    """The keys, in order, that are not done for a target; another target begins anew."""
    done = {r.key for r in _rows(spark, DONE, path).where(F.col("target") == target).collect()}  # as many as there are steps
    return [k for k in keys if k not in done]


def mark_done(spark: SparkSession, path: str, target: str, key: str) -> None:
    spark.createDataFrame([(target, key)], DONE).coalesce(1).write.mode("append").parquet(path)
