"""State with an end: what each key has seen lately, bounded in time and in number.

A key remembers its items for ttl seconds and at most so many; a new item beyond that takes the place of the oldest. State
is a map from item to its time, kept by the state store item by item, and a timer takes away what has expired even if
nothing more comes for the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


def seen_lately(events: list[tuple[int, str]], held: dict[str, int], ttl: int, most: int) -> list[bool]:
    """For (time in microseconds, item) in order: whether held has the item still. held is brought up to date: an item that
    is seen keeps the time at which it came in."""
    out = []
    for at, item in events:
        for old in [k for k, t in held.items() if t + ttl * 1_000_000 <= at]:
            del held[old]
        out.append(item in held)
        if item not in held:
            if len(held) >= most:
                del held[min(held, key=lambda k: (held[k], k))]
            held[item] = at
    return out


class _Lately(StatefulProcessor):
    def __init__(self, key: str, item: str, ts: str, ttl: int, most: int):
        self.key, self.item, self.ts, self.ttl, self.most = key, item, ts, ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", StructType([StructField("item", StringType())]), StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        times = (every[self.ts].astype("int64") // (1000 if str(every[self.ts].dtype).startswith("datetime64[ns") else 1)).tolist()
        fresh = sorted(zip(times, every[self.item].tolist(), strict=True))
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        held = dict(before)
        hits = seen_lately(fresh, held, self.ttl, self.most)
        for item in before.keys() - held.keys():
            self.held.removeKey((item,))
        for item, at in held.items():
            if before.get(item) != at:
                self.held.updateValue((item,), (at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(max(held.values()) // 1000 + self.ttl * 1000)
        yield pd.DataFrame({self.key: key[0], self.item: [i for _, i in fresh], "at": [t for t, _ in fresh], "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def lately_stream(events: DataFrame, key: str, item: str, ts: str, ttl: int = 1800, most: int = 1000, late: str = "1 minute") -> DataFrame:
    """(key, item, at, hit) of a stream: whether the key still remembers the item. Needs the RocksDB state store."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, item, ts).withWatermark(ts, late).groupBy(key)
    return rows.transformWithStateInPandas(_Lately(key, item, ts, ttl, most), f"{key} {kind}, {item} string, at long, hit boolean", "Append", "EventTime")
