"""Merges as rewrites of a snapshot: plain files have no MERGE, so each gives the new content of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import versions


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    return old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), same, "full_outer")


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and action: insert, update (the value differs, nulls being equal) or keep."""
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNotNull() & ~F.col(f"o.{value}").eqNullSafe(F.col(f"n.{value}")), "update").otherwise("keep")
    picked = F.when(F.col("_new").isNotNull(), F.col(f"n.{value}")).otherwise(F.col(f"o.{value}"))
    return _both(old, new, keys).select(*(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys), picked.alias(value), action.alias("action"))


def versioned_upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str, version: int) -> DataFrame:
    """Created stays the earliest, updated moves where the value changes. Ids are taken as ordered by their version."""
    changed = F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col(f"o.{value}").eqNullSafe(F.col(f"n.{value}"))
    given, arrives = F.lit(version).cast("long"), F.col("_new").isNotNull()
    created, updated = F.col("o.created_version_id"), F.col("o.updated_version_id")
    first = F.when(arrives, versions.prefer(created, given, created, given, True)).otherwise(created)
    last = F.when(F.col("_old").isNull(), given).when(changed, versions.prefer(updated, given, updated, given, False)).otherwise(updated)
    return _both(old, new, keys).select(
        *(F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys),
        F.when(arrives, F.col(f"n.{value}")).otherwise(F.col(f"o.{value}")).alias(value),
        first.alias("created_version_id"),
        last.alias("updated_version_id"),
    )


def prune(old: DataFrame, seen: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """Rows outside the scope, and those inside it whose key was seen."""
    return old.where(~scope).unionByName(old.where(scope).join(seen.select(*keys).distinct(), keys, "left_semi"))


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Every scope that new speaks of is new's alone."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").unionByName(new.select(*old.columns))


def name_status(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): A added, D deleted, M changed."""
    both = _both(old, new, [key])
    status = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").when(~F.col(f"o.{digest}").eqNullSafe(F.col(f"n.{digest}")), "M")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), status.alias("status")).where("status is not null")
