import os
import random

import pandas as pd
from pyspark.sql import functions as F

from textloom.sources import snapshots
from textloom.streaming import memory, sinks


def test_two_tables_and_a_restart(spark, tmp_path):
    """A driver that dies between the tables and the log leaves nothing to see; the batch then comes again."""
    path, feed = f"file://{tmp_path}/out", tmp_path / "in"
    feed.mkdir()
    pd.DataFrame({"k": ["a", "b"], "v": [1, 2]}).to_parquet(feed / "1.parquet")
    parts = {"all": lambda b: b, "high": lambda b: b.where("v > 1").select("k")}
    read = lambda: spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(f"file://{feed}")
    real = sinks.commit
    calls = []

    def dies(session, out, number, tables):
        calls.append(number)
        if number == 1 and calls.count(1) == 1:
            for name, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
            raise RuntimeError("lost")
        return real(session, out, number, tables)

    sinks.commit = dies
    try:
        sinks.multi_sink(read(), path, parts, f"file://{tmp_path}/cp").awaitTermination(60)
        pd.DataFrame({"k": ["a", "c"], "v": [7, 0]}).to_parquet(feed / "2.parquet")
        try:
            sinks.multi_sink(read(), path, parts, f"file://{tmp_path}/cp").awaitTermination(60)
        except Exception as lost:
            assert "lost" in str(lost)
        rows = lambda: {tuple(r) for r in sinks.visible(spark, path, "all", "k string, v long").select("k", "v").collect()}
        assert rows() == {("a", 1), ("b", 2)}
        sinks.multi_sink(read(), path, parts, f"file://{tmp_path}/cp").awaitTermination(60)
    finally:
        sinks.commit = real
    assert rows() == {("a", 1), ("b", 2), ("a", 7), ("c", 0)}
    assert sorted(r.k for r in sinks.visible(spark, path, "high", "k string").collect()) == ["a", "b"]
    last = sinks.latest(sinks.visible(spark, path, "all", "k string, v long"), ["k"], "v")
    assert {tuple(r) for r in last.collect()} == {("a", 7), ("b", 2), ("c", 0)}
    assert sinks.visible(spark, f"file://{tmp_path}/none", "all", "k string").count() == 0


def test_resume(spark, tmp_path):
    path = f"file://{tmp_path}/done"
    assert sinks.pending(spark, path, "t1", ["a", "b", "c"]) == ["a", "b", "c"]
    sinks.mark_done(spark, path, "t1", "a")
    sinks.mark_done(spark, path, "t1", "c")
    assert sinks.pending(spark, path, "t1", ["a", "b", "c"]) == ["b"] and sinks.pending(spark, path, "t2", ["a"]) == ["a"]


def test_memory_rule():
    held: dict[str, int] = {}
    s = 1_000_000
    events = [(0, "a"), (1 * s, "b"), (2 * s, "a"), (3 * s, "c"), (4 * s, "a"), (5 * s, "b"), (20 * s, "c")]
    # c at 3 takes a's place, as a came first; a at 4 takes b's; b at 5 takes c's; at 20 all have expired.
    assert memory.seen_lately(events, held, 10, 2) == [False, False, True, False, False, False, False] and held == {"c": 20 * s}


def test_memory_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = sorted((pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i * 3 + rng.random()), rng.choice("xyz"), rng.choice("abcdef")) for i in range(120))
    feed = tmp_path / "in"
    feed.mkdir()
    for i in range(3):
        part = rows[i * 40 : (i + 1) * 40]
        pd.DataFrame({"ts": pd.Series([r[0] for r in part], dtype="datetime64[us]"), "k": [r[1] for r in part], "item": [r[2] for r in part]}).to_parquet(feed / f"{i}.parquet")
        os.utime(feed / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, k string, item string").option("maxFilesPerTrigger", 1).parquet(f"file://{feed}")
    out = memory.lately_stream(stream, "k", "item", "ts", ttl=40, most=3)
    out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.k, r.at, r.item, r.hit) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = []
    for key in "xyz":
        held: dict[str, int] = {}
        own = [(t.value // 1000, item) for t, k, item in rows if k == key]
        want += [(key, t, item, hit) for (t, item), hit in zip(own, memory.seen_lately(own, held, 40, 3), strict=True)]
    assert got == sorted(want) and {True, False} == {h for *_, h in want}


def test_files_of_roots(spark, tmp_path):
    for root, name, text in (("r1", "a/x.txt", "one"), ("r2", "a/x.txt", "two"), ("r2", "b y.txt", "three"), ("r2", "c.bin", "no")):
        (tmp_path / root / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / root / name).write_text(text)
    roots = [snapshots.files(spark, f"file://{tmp_path}/{r}", "*.txt") for r in ("r1", "r2")]
    assert sorted(map(tuple, snapshots.first_root(roots).collect())) == [("a/x.txt", "one", 0), ("b y.txt", "three", 1)]
    changes = spark.createDataFrame([(1, "p", "old"), (2, "p", None), (3, "p", "new"), (1, "q", "stays")], "version long, path string, content string")
    at = lambda v: {tuple(r) for r in snapshots.as_of(changes, v).collect()}
    assert at(1) == {("p", "old", 1), ("q", "stays", 1)} and at(2) == {("q", "stays", 1)} and ("p", "new", 3) in at(3)
    assert snapshots.as_of(changes.where(F.lit(False)), 3).count() == 0
