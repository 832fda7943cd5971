"""Operator 10: balanced label propagation over documents with equal texts, in DataFrame operations only.

First labels: the linked documents (equal texts), groups one after another and large ones first, are laid along the shards in
equal stretches, so each border between two shards cuts one group at most and free places are the same in all shards. In
each round a group's documents propose to move to the group's target shards: the one that holds most of it, or for a group
that no shard can hold alone, as many shards as it needs, those first that hold or have room for most of it; a group that
a border cuts and whose shards have no room asks for the shard that has most. A shard takes movers up to its quota: into
its free places, and one for one against movers that go the other way, so no load ever exceeds its capacity. Rounds follow
one another while the number of pairs kept together rises. Documents that are linked with none fill the rest, so shard
sizes in rows differ by one at most (law ``rows``), whatever the links.

The state is one row for each group and shard (members of a group are alike), so a group that holds a third of all rows
is forty rows of state. Nothing but forty numbers reaches the driver.

Defined results: a null text counts as empty bytes and is equal to other null texts, not to empty ones, which are equal
to each other; very long texts are told by a digest of the whole; rows that repeat, with or without a doc_id, are
documents of their own; with fewer rows than shards some shards stay empty; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Buckets of a flow between two shards, which is dealt out by running totals.
BUCKETS = 64


def capacity(rows: int, shards: int):
    """Places of a shard: all have rows // shards, the first rows % shards have one more."""
    return F.lit(rows // shards) + (F.col("shard") < rows % shards).cast("long")


def spread(groups: DataFrame, rows: int, shards: int) -> DataFrame:
    """First labels, (gid, shard, cnt): the members of all groups (gid, n), large groups first, in a stretch for each shard.

    Stretches end at places that follow the capacities, so none is longer than its shard's capacity.
    """
    linked = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ends = [linked * ((s + 1) * (rows // shards) + min(s + 1, rows % shards)) // max(1, rows) for s in range(shards)]
    # Groups of like size (by powers of two) follow one another; there are 63 such sizes at most.
    sized = groups.withColumn("log", F.floor(F.log2("n")).cast("int"))
    totals = sized.groupBy("log").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("groups"))
    larger = Window.orderBy(F.desc("log")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("log", "groups", F.coalesce(F.sum("m").over(larger), F.lit(0)).alias("base"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("groups") / common.ROWS_PER_BUCKET))
    placed = common.running_total(sized.join(F.broadcast(totals), "log"), ["log"], "gid", F.col("n"), buckets, "at")
    at = F.col("base") + F.col("at")
    stretches = F.array(*(F.struct(F.lit(s).cast("long").alias("shard"), F.lit(begin).cast("long").alias("begin"), F.lit(end).cast("long").alias("end")) for s, (begin, end) in enumerate(zip([0, *ends], ends, strict=False))))
    share = F.transform(stretches, lambda e: F.struct(e["shard"].alias("shard"), (F.least(e["end"], at + F.col("n")) - F.greatest(e["begin"], at)).alias("cnt")))
    return placed.select("gid", F.explode(F.filter(share, lambda x: x["cnt"] > 0)).alias("x")).select("gid", "x.shard", "x.cnt")


def proposals(state: DataFrame, free: DataFrame, rows: int, shards: int) -> DataFrame:
    """(gid, src, dst, cnt): documents of a group outside its target shards, and the target that they ask for."""
    votes = state.join(F.broadcast(free), "shard")  # a row for each shard
    group = Window.partitionBy("gid")
    votes = votes.withColumn("n", F.sum("cnt").over(group))
    could = F.least(F.col("n"), F.col("cnt") + F.col("free"))
    order = Window.partitionBy("gid").orderBy(could.desc(), F.col("cnt").desc(), F.xxhash64("gid", "shard"), "shard")
    votes = votes.withColumn("nth", F.row_number().over(order) - 1)
    votes = votes.withColumn("covered", F.coalesce(F.sum(could).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    needed = F.ceil(F.col("n") / max(1, -(-rows // shards)))
    votes = votes.withColumn("target", (F.col("nth") < needed) | ((F.col("free") > 0) & (F.col("covered") < F.col("n"))))
    votes = votes.withColumn("targets", F.array_sort(F.collect_set(F.when(F.col("target"), F.col("shard"))).over(group)))
    dst = F.element_at("targets", (F.pmod(F.col("nth"), F.size("targets")) + 1).cast("int"))
    return votes.where("not target").select("gid", F.col("shard").alias("src"), dst.alias("dst"), "cnt")


def propagate(state: DataFrame, rows: int, shards: int) -> DataFrame:
    """One round: (gid, shard, cnt) before and after."""
    all_shards = state.sparkSession.range(shards).select(F.col("id").alias("shard"))
    load = state.groupBy("shard").agg(F.sum("cnt").alias("load"))
    free = all_shards.join(load, "shard", "left").select("shard", (capacity(rows, shards) - F.coalesce("load", F.lit(0))).alias("free"))
    wants = proposals(state, free, rows, shards)
    # Flows are a row for each two shards at most.
    flows = wants.groupBy("src", "dst").agg(F.sum("cnt").alias("want"))
    back = flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("want").alias("back"))
    both = flows.join(F.broadcast(back), ["src", "dst"], "left").withColumn("swap", F.least("want", F.coalesce("back", F.lit(0))))
    both = both.join(F.broadcast(free.select(F.col("shard").alias("dst"), "free")), "dst").withColumn("rest", F.col("want") - F.col("swap"))
    by_dst = Window.partitionBy("dst").orderBy(F.col("rest").desc(), "src").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("rest").over(by_dst), F.lit(0))
    quota = both.withColumn("admitted", F.col("swap") + F.greatest(F.lit(0), F.least(F.col("rest"), F.col("free") - taken))).select("src", "dst", "admitted")
    # Admit movers of each flow up to its quota; running totals by bucket, so that no flow is one task's.
    wants = wants.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(BUCKETS)))
    sums = wants.groupBy("src", "dst", "bucket").agg(F.sum("cnt").alias("m"))
    earlier = Window.partitionBy("src", "dst").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "dst", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "dst", "bucket").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)
    moved = (
        wants.join(F.broadcast(quota), ["src", "dst"])
        .join(F.broadcast(sums), ["src", "dst", "bucket"])
        .withColumn("used", F.col("before") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .withColumn("go", F.greatest(F.lit(0), F.least(F.col("cnt"), F.col("admitted") - F.col("used"))))
        .where("go > 0")
    )
    changes = moved.select("gid", F.explode(F.array(F.struct(F.col("src").alias("shard"), (-F.col("go")).alias("cnt")), F.struct(F.col("dst").alias("shard"), F.col("go").alias("cnt")))).alias("x")).select("gid", "x.shard", "x.cnt")
    return state.unionByName(changes).groupBy("gid", "shard").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def settled(state: DataFrame, rows: int, shards: int) -> DataFrame:
    """The labels after so many rounds as pay."""
    kept = lambda s: s.agg(F.coalesce(F.sum(F.col("cnt").cast("double") * F.col("cnt")), F.lit(0.0))).first()[0]
    best = kept(state)
    while best:
        after = common.written(propagate(state, rows, shards), "shard-state")
        now = kept(after)
        if now <= best:
            break
        state, best = after, now
    return state


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows of docs with size, text_crc32, law, shard, slot and grown_shard (null under law ``rows``)."""
    text = F.col("text").cast("binary")
    base = common.written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("null")).alias("gid"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-base",
    )
    rows = base.count()
    groups = base.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = common.written(groups, "shard-groups")
    state = settled(common.written(spread(groups, rows, shards), "shard-state"), rows, shards)
    # Places of the linked documents: the shards of a group one after another, its members in turn.
    upto = Window.partitionBy("gid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    places = state.select("gid", "shard", F.sum("cnt").over(upto).alias("upto")).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("places"))
    known = common.written(groups.join(places, "gid"), "shard-known")
    # A hot group is never one task's: groups of a thousandth of all rows are broadcast.
    linked = common.joined_by_share(base, known, "gid", "n", rows)
    linked = common.numbered(linked, ["gid"], "rid", F.ceil(F.col("n") / common.ROWS_PER_BUCKET), "place")
    linked = linked.select("doc_id", "size", "text_crc32", "rid", F.filter("places", lambda p: p["upto"] > F.col("place"))[0]["shard"].alias("shard"))
    # The rest fill what is left of each shard; forty numbers tell where each shard's share of them ends.
    load = {r["shard"]: r["load"] for r in state.groupBy("shard").agg(F.sum("cnt").alias("load")).collect()}
    room = [rows // shards + (s < rows % shards) - load.get(s, 0) for s in range(shards)]
    if min(room) < 0:
        raise ValueError(f"a shard has more documents than places: {room}")
    single = base.join(F.broadcast(groups.where(F.col("n") * 1000 >= rows)), "gid", "left_anti")
    single = single.join(groups.where(F.col("n") * 1000 < rows), "gid", "left_anti").select("doc_id", "size", "text_crc32", "rid")
    single = common.numbered(single, [], "rid", common.buckets_for(rows), "place")
    ends, end = F.lit(None).cast("long"), sum(room)
    for s in reversed(range(shards)):
        ends = F.when(F.col("place") < end, F.lit(s).cast("long")).otherwise(ends)
        end -= room[s]
    single = single.withColumn("shard", ends).drop("place")
    placed = common.written(linked.unionByName(single), "shard-placed")
    out = common.numbered(placed, ["shard"], "rid", common.buckets_for(-(-rows // shards)), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir))
