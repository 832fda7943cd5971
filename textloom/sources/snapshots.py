"""Files as of a point in time: changes of paths along versions, and several roots of which the first that has a path counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def as_of(changes: DataFrame, version: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, version) of changes (version, path, content) up to a version: a path's last change, unless that took
    it away (null content). keep: path prefixes, pushed to the source."""
    rows = changes.where(F.col("version") <= version)
    if keep:
        rows = rows.where(reduce(lambda a, b: a | b, (F.startswith("path", F.lit(p)) for p in keep)))
    last = rows.groupBy("path").agg(F.max_by(F.struct("content", "version"), F.struct("version", F.coalesce("content", F.lit("")))).alias("_last"))
    return last.where("_last.content is not null").select("path", "_last.content", "_last.version")


def first_root(roots: list[DataFrame]) -> DataFrame:
    """(path, content, root): of several roots (path, content) the first that has a path; root counts from 0."""
    every = [d.select("path", "content", F.lit(i).alias("root")) for i, d in enumerate(roots)]
    rows = reduce(lambda a, b: a.unionByName(b), every)
    return rows.groupBy("path").agg(F.min_by(F.struct("content", "root"), F.struct("root", F.coalesce("content", F.lit("")))).alias("_first")).select("path", "_first.content", "_first.root")


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of the text files under a root, paths relative to it; Spark lists, splits and reads them, wherever
    the store is."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    # The root as Spark writes it may have another scheme: a path is what follows the root's own last part.
    base = "/" + root.rstrip("/").split("://")[-1].strip("/") + "/"
    name = F.url_decode(F.regexp_replace("_metadata.file_path", "\\+", "%2B"))
    return found.select(F.substring_index(name, base, -1).alias("path"), F.col("value").alias("content"))
