"""Version marks: floors, earliest versions, what happened to source files, resets, and the stretch of a history to replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import versions

#: A version without a sort key comes after all others (fixed value).
LAST = 2_147_483_647


def _keys(dim: DataFrame, name: str) -> DataFrame:
    return dim.select(F.col("id").alias(name), F.coalesce("version_sort_key", F.lit(LAST)).alias(f"{name}_key"))


def floored(rows: DataFrame, floor: str, created: str, dim: DataFrame) -> DataFrame:
    """rows whose created is that of floor where it is missing or later than it; dim: (id, version_sort_key)."""
    joined = rows.join(_keys(dim, floor), floor, "left").join(_keys(dim, created), created, "left")
    earlier = F.coalesce(F.col(f"{floor}_key"), F.lit(LAST)) < F.coalesce(F.col(f"{created}_key"), F.lit(LAST))
    takes = F.col(floor).isNotNull() & (F.col(created).isNull() | earlier)
    return joined.withColumn(created, F.when(takes, F.col(floor)).otherwise(F.col(created))).select(*rows.columns)


def earliest(old: DataFrame, new: DataFrame, key: str, value: str, created: str, dim: DataFrame) -> DataFrame:
    """Rows of both by key: new's value where it has the key, and the earlier of both versions; a missing one counts as later."""
    cur = new.select(key, F.col(value).alias("_value"), F.col(created).alias("_created"), F.lit(True).alias("_new"))
    both = old.select(key, value, created).join(cur, key, "full")
    both = both.join(_keys(dim, created), created, "left").join(_keys(dim, "_created"), "_created", "left")
    late = lambda c: F.coalesce(F.col(c), F.lit(LAST))
    first = F.when(F.col(created).isNull(), F.col("_created")).when(F.col("_created").isNull(), F.col(created)).when(late("_created_key") < late(f"{created}_key"), F.col("_created")).otherwise(F.col(created))
    return both.select(key, F.when(F.col("_new"), F.col("_value")).otherwise(F.col(value)).alias(value), first.alias(created))


def file_versions(changes: DataFrame) -> DataFrame:
    """(path, created, updated, action) of changes (nth, version, action, old_path, new_path): the version in which a path
    came first and its last change; a deletion counts for the path that went."""
    rows = changes.withColumn("path", F.when(F.col("action") == "D", F.col("old_path")).otherwise(F.col("new_path"))).where("path <> ''")
    at = F.struct("nth", "version", "action")
    return rows.groupBy("path").agg(F.min_by("version", at).alias("created"), F.max_by("version", at).alias("updated"), F.max_by("action", at).alias("action"))


def reset(rows: DataFrame, columns: tuple[str, ...], where: Column | None = None) -> DataFrame:
    """rows without the marks in columns, where given of those rows alone."""
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType)
    return rows.withColumns({c: none(c) if where is None else F.when(F.coalesce(where, F.lit(False)), none(c)).otherwise(F.col(c)) for c in columns})


def labelled(commits: DataFrame, overrides: DataFrame) -> DataFrame:
    """commits (sha, title) with label and tag: those of the title, unless overrides (sha, tag) names another for the commit,
    or the title's own label corrects its tag (fixed value: 4.0.1 is 4.1)."""
    label = F.lower(F.trim("title"))
    tag = versions.tag(F.col("title"))
    rows = commits.join(F.broadcast(overrides.select("sha", F.col("tag").alias("_other"))), "sha", "left").withColumn("_tag", tag)
    other = F.when(F.col("_tag").isNull(), None).otherwise(F.coalesce("_other", F.when((F.col("_tag") == "4.0") & F.contains("title", F.lit("4.0.1")), "4.1")))
    return rows.select("sha", "title", F.coalesce(other, F.when(F.col("_tag").isNotNull(), label)).alias("label"), F.coalesce(other, F.col("_tag")).alias("tag"))


def replay_range(snapshots: DataFrame, target: str, start: str | None = None) -> DataFrame:
    """(nth, tag, role) of snapshots (nth, tag) from after start up to target: those to replay, and the one before them as
    base. Nothing where there is no such target."""
    ends = snapshots.agg(F.max(F.when(F.col("tag") == target, F.col("nth"))).alias("_to"), F.max(F.when(F.col("tag") == start, F.col("nth"))).alias("_from"))
    rows = snapshots.join(F.broadcast(ends), F.lit(True))  # one row
    first = F.coalesce("_from", F.lit(-1)) + 1
    role = F.when(F.col("nth").between(first, F.col("_to")), "replay").when(F.col("_to").isNotNull() & (F.col("nth") == first - 1), "base")
    return rows.select("nth", "tag", role.alias("role")).where("role is not null")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the last: a later row takes the place of an earlier one."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_nth = 1").drop("_nth")
