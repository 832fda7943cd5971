"""Versions along a history: when a text was created and last changed, by following it from snapshot to snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import lineage
from .running import most_of_one, numbered
from .scratch import written


def row_plan(current: DataFrame, existing: DataFrame, version: int, similar: bool = False) -> DataFrame:
    """(hash, content, created, updated) of current (hash, content), by the texts of existing (the same four columns).

    A text that continues another inherits its created version, and its updated version too if the content is the same.
    """
    previous = existing.select("hash", "content")
    matched = lineage.same_content(current, previous)
    matched = matched.unionByName(lineage.changed(current, previous, matched))
    if similar:
        matched = written(matched, "history-matched")
        rest = current.join(matched, "hash", "left_anti")
        free = previous.join(matched.select(F.col("previous_hash").alias("hash")), "hash", "left_anti")
        matched = matched.unionByName(lineage.similar(rest, free).select("hash", "previous_hash", F.lit("similar").alias("kind")))
    known = matched.join(existing.select(F.col("hash").alias("previous_hash"), "created", "updated"), "previous_hash").select("hash", "kind", "created", "updated")
    same = F.col("kind").isin("same_hash", "moved")
    given = F.lit(version).cast("long")
    return current.join(known, "hash", "left").select(
        "hash", "content", F.coalesce("created", given).alias("created"), F.when(same, F.col("updated")).otherwise(given).alias("updated")
    )


def replay(snapshots: list[tuple[int, DataFrame]], similar: bool = False) -> DataFrame:
    """(hash, content, created, updated) of the last of the snapshots (version, rows of hash and content), oldest first.

    Created is the version in which a text's line of predecessors begins, updated the one of its last change of content.
    Each step is written, so a plan never holds more than one.
    """
    (version, first), *rest = snapshots
    given = F.lit(version).cast("long")
    state = first.select("hash", "content", given.alias("created"), given.alias("updated"))
    for version, rows in rest:
        state = written(row_plan(rows.select("hash", "content"), state, version, similar), "history-state")
    return state


def updates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of after (hash, content, created, updated) whose versions or content are not those of before: what a step writes."""
    same = before.select("hash", F.col("content").alias("_c"), F.col("created").alias("_a"), F.col("updated").alias("_b"))
    joined = after.join(same, "hash", "left")
    equal = F.col("content").eqNullSafe(F.col("_c")) & F.col("created").eqNullSafe(F.col("_a")) & F.col("updated").eqNullSafe(F.col("_b"))
    return joined.where(~equal).select("hash", "content", "created", "updated")


def moved_texts(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For (key, content) on both sides: the keys that both hold (key, same), and the moves (key, old_key).

    A new key takes over the text of an old key that is gone, k-th to k-th of each text, so nothing but its key changed.
    """
    both = new.join(old.select("key", F.col("content").alias("_old")), "key").select("key", F.col("content").eqNullSafe(F.col("_old")).alias("same"))
    digest = F.coalesce(F.md5(F.col("content").cast("binary")), F.lit("-"))
    rest = lambda d: d.join(both, "key", "left_anti").select("key", digest.alias("digest"))
    most = max(most_of_one(rest(new), ["digest"]), most_of_one(rest(old), ["digest"]))
    nth = lambda d: numbered(rest(d), ["digest"], "key", "nth", most)
    moves = nth(new).join(nth(old).withColumnRenamed("key", "old_key"), ["digest", "nth"]).select("key", "old_key")
    return both, moves


def changed_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of new whose text changed; a text that only moved to another key has not."""
    both, moves = moved_texts(old, new)
    return new.select("key").join(both.where("same").select("key").union(moves.select("key")), "key", "left_anti")


def subtitle_versions(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """(key, content, created, updated) of new (key, content): lines that only moved keep the versions of old."""
    both, moves = moved_texts(old, new)
    had = old.select(F.col("key").alias("old_key"), F.col("created").alias("_created"), F.col("updated").alias("_updated"))
    origin = both.select("key", F.col("key").alias("old_key"), "same").unionByName(moves.withColumn("same", F.lit(True)))
    joined = new.join(origin, "key", "left").join(had, "old_key", "left")
    given = F.lit(version).cast("long")
    # Ids are taken as ordered by their version; a changed line is as old as its key and as new as this version.
    created = F.when(F.col("same"), F.col("_created")).otherwise(F.least("_created", given))
    updated = F.when(F.col("same"), F.col("_updated")).otherwise(F.greatest("_updated", given))
    return joined.select("key", "content", created.alias("created"), updated.alias("updated"))


def readable_versions(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """(key, content, created, updated) of new (key, content): an unchanged text keeps its versions of old."""
    had = old.select("key", F.col("content").alias("_content"), F.col("created").alias("_created"), F.col("updated").alias("_updated"), F.lit(True).alias("_had"))
    joined = new.join(had, "key", "left")
    same = F.col("_had").isNotNull() & F.col("content").eqNullSafe(F.col("_content"))
    given = F.lit(version).cast("long")
    return joined.select(
        "key", "content", F.when(same, F.col("_created")).otherwise(F.least("_created", given)).alias("created"), F.when(same, F.col("_updated")).otherwise(given).alias("updated")
    )


def appearances(snapshots: DataFrame) -> DataFrame:
    """(key, created, updated) of snapshots (key, version, content), versions numbered without gaps: created is the latest
    (re)appearance of a key that the last of its snapshots still follows, updated the first after it with today's text."""
    by = Window.partitionBy("key").orderBy("version")
    rows = snapshots.withColumn("_before", F.lag("version").over(by))
    starts = F.max(F.when(F.col("_before").isNull() | (F.col("_before") < F.col("version") - 1), F.col("version")))
    whole = Window.partitionBy("key")
    rows = rows.select("key", "version", "content", starts.over(whole).alias("created"), F.max_by("content", "version").over(whole).alias("_now"))
    own = F.when((F.col("version") >= F.col("created")) & F.col("content").eqNullSafe(F.col("_now")), F.col("version"))
    return rows.groupBy("key", "created").agg(F.min(own).alias("updated"))
