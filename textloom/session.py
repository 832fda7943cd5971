"""A session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", **more: str) -> SparkSession:
    """Adaptive execution splits skewed joins and merges small partitions; times are UTC; overflows raise."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=conf | more).getOrCreate()
