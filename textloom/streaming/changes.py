"""Change feeds as streams: idempotent merges of micro-batches, and an exact sliding count for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def merge_stream(feed: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's last row of each key, under its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.xxhash64(*batch.columns)))
        rows = batch.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged(batches: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table that the batches of merge_stream make: the last row of each key."""
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc(order))
    return batches.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "batch")


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with n: how many of the key's events lie in the last seconds, this one included."""
    at = F.unix_micros(ts)
    return events.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)))


def sliding_count_stream(events: DataFrame, key: str, ts: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """The same on a stream, by state: (key, ts, n). A key's state is the times of its last seconds, dropped when they pass."""

    def step(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        fresh = sorted(int(t.value // 1000) for b in batches for t in b[ts])
        out = []
        for t in fresh:
            held = [x for x in held if x >= t - seconds * 1_000_000] + [t]
            out.append((own[0], pd.Timestamp(t, unit="us"), len(held)))
        state.update((held,))
        state.setTimeoutTimestamp(max(fresh[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, ts, "n"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, late).groupBy(key)
    return rows.applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, n long", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def each_batch(feed: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return feed.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
