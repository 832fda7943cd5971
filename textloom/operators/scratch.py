"""Tables between steps: written to the folder that the driver and all executors share, so lost executors take nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Without one the warehouse will do, but on a cluster only if it was set:
    by default it is a folder of the driver's own machine."""
    own = spark.sparkContext.getConf()
    found = own.get("spark.checkpoint.dir") or own.get("spark.sql.warehouse.dir")
    if not found and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        found = spark.conf.get("spark.sql.warehouse.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


#: With this setting Spark takes away the shuffles of a query when it has ended, not when the driver's heap is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def appended(parts: Iterable[DataFrame], schema: StructType | str, label: str) -> DataFrame:
    """A table of all parts, one or more, and a reader of it; each is written, and its shuffles are gone, before the next is
    asked for. Empty the folder when no job runs."""
    path = ""
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table and return a reader of it."""
    return appended([df], df.schema, label)


def clear(spark: SparkSession) -> bool:
    """Take away all tables between steps; for when no job runs and nothing that reads one is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/textloom")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
