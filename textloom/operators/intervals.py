"""Versions as intervals: when keys were there, when all keys of a group were, and what versions a group gets by that.

Versions are numbered without gaps. An interval (start, end) holds both of its ends.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lifelines(presence: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the unbroken stretches of versions in which a key is there; presence: (key, version)."""
    rows = presence.select(key, "version").distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("version"))
    island = rows.withColumn("_island", F.col("version") - nth)
    return island.groupBy(key, "_island").agg(F.min("version").alias("start"), F.max("version").alias("end")).drop("_island")


def together(members: DataFrame, lines: DataFrame, group: str, key: str) -> DataFrame:
    """(group, start, end): the longest intervals in which all of a group's keys are there, by a sweep over the ends of
    their intervals. A group has as many rows in the sweep as there are versions, however many keys it has."""
    members = members.select(group, key).distinct()
    size = members.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    steps = members.join(lines, key).select(
        group, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")
    )
    steps = steps.groupBy(group, F.col("e.at").alias("start")).agg(F.sum("e.step").alias("_step"))
    order = Window.partitionBy(group).orderBy("start")
    sweep = steps.withColumn("_there", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("start").over(order) - 1)
    full = sweep.join(size, group).where("_there = _size")
    # Intervals that touch are one.
    fresh = F.coalesce((F.col("start") > F.lag("end").over(order) + 1).cast("int"), F.lit(1))
    full = full.withColumn("_run", fresh).withColumn("_run", F.sum("_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return full.groupBy(group, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def changes(snapshots: DataFrame, key: str, content: str) -> DataFrame:
    """(key, version): versions in which a key's content is not that of its snapshot before, if it was there; else none."""
    order = Window.partitionBy(key).orderBy("version")
    rows = snapshots.withColumn("_before", F.lag(content).over(order)).withColumn("_v", F.lag("version").over(order))
    return rows.where((F.col("_v") == F.col("version") - 1) & ~F.col("_before").eqNullSafe(F.col(content))).select(key, "version")


def replay_groups(members: DataFrame, snapshots: DataFrame, first_seen: DataFrame, group: str, key: str, content: str) -> DataFrame:
    """(group, created, updated, resolved) of groups of texts over their snapshots (key, version, content).

    Created is when the last time began that all texts were there; for a group that never was whole, the version in which
    most of its texts came first, the earlier of equal ones. No group is older than its own first snapshot (group,
    version), where that is known. Updated is the last version in which a text of it changed, and never before created.
    """
    lines = lifelines(snapshots, key)
    whole = together(members, lines, group, key).groupBy(group).agg(F.max("start").alias("_whole"))
    born = members.select(group, key).distinct().join(lines.groupBy(key).agg(F.min("start").alias("_born")), key)
    votes = born.groupBy(group, "_born").agg(F.count(F.lit(1)).alias("_n"))
    vote = votes.groupBy(group).agg(F.min_by("_born", F.struct(-F.col("_n"), "_born")).alias("_vote"))
    last = members.select(group, key).distinct().join(changes(snapshots, key, content), key).groupBy(group).agg(F.max("version").alias("_changed"))
    floor = first_seen.groupBy(group).agg(F.min("version").alias("_floor"))
    joined = members.select(group).distinct()
    for side in (whole, vote, last, floor):
        joined = joined.join(side, group, "left")
    created = F.greatest(F.coalesce("_whole", "_vote", "_floor"), F.col("_floor"))
    return joined.select(group, created.alias("created"), F.greatest(created, F.col("_changed")).alias("updated"), F.col("_whole").isNotNull().alias("resolved"))


def affected(lookups: list[DataFrame], group: str) -> DataFrame:
    """The groups that any of several lookups finds, once each."""
    return reduce(lambda a, b: a.unionByName(b), (d.select(group) for d in lookups)).distinct()


def repaired(state: DataFrame, recomputed: DataFrame, which: DataFrame, group: str) -> DataFrame:
    """state with the rows of the groups in which taken from recomputed (the same columns); a group that is not in
    recomputed any more goes."""
    stay = state.join(which, group, "left_anti")
    return stay.unionByName(recomputed.join(which, group, "left_semi").select(*state.columns))
