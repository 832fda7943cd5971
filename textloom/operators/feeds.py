"""What changed between two manifests of files (path, content): added, modified, deleted and renamed.

A deleted file that an added one continues is a rename: first where the whole content is the same, k-th to k-th of each
content; then where lines that both hold make up a share of the larger of the two, and each is the other's best. Candidates
come from a prefix filter: a file's lines, rarest first, are joined only as long as what follows could still make up the
share, so lines that every file holds join nothing; the shares are then counted over all lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import most_of_one, numbered

#: Percent of the larger file's bytes that a renamed file keeps at least (fixed value).
SHARE = 50


def in_scope(path: Column, scope: tuple[str, ...]) -> Column:
    """Paths of the folders or files named; all without a scope."""
    one = lambda p: (path == p.rstrip("/")) | F.startswith(path, F.lit(p.rstrip("/") + "/"))
    return reduce(lambda a, b: a | b, map(one, scope)) if scope else F.lit(True)


def _lines(files: DataFrame) -> DataFrame:
    """(path, line, n, bytes, total): how often a file holds a line, its bytes all told, and those of the file."""
    each = files.select("path", F.explode(F.split("content", "\n", -1)).alias("text"))
    each = each.select("path", F.xxhash64("text", F.length("text")).alias("line"), (F.octet_length("text") + 1).cast("long").alias("bytes"))
    found = each.groupBy("path", "line", "bytes").agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("total", F.sum(F.col("n") * F.col("bytes")).over(Window.partitionBy("path")))


def sharing(a: DataFrame, b: DataFrame, share: int) -> DataFrame:
    """(old_path, new_path, larger, kept) of two sides of multisets, (path, line, n, bytes, total): pairs that hold so many
    percent of the larger one's bytes in common, and how many bytes these are. Exact: no pair is left out."""
    every = a.select("line").unionByName(b.select("line")).groupBy("line").agg(F.count(F.lit(1)).alias("files"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        rare = Window.partitionBy("path").orderBy(F.asc("files"), F.asc("line"), F.asc("bytes")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        rest = side.join(every, "line").withColumn("rest", F.sum(F.col("n") * F.col("bytes")).over(rare))
        return rest.where(F.col("rest") * 100 >= F.col("total") * share).select("line", F.col("path").alias(f"{name}_path"), F.col("total").alias(f"{name}_total"))

    larger = F.greatest("old_total", "new_total")
    pairs = prefix(a, "old").join(prefix(b, "new"), "line").where(F.least("old_total", "new_total") * 100 >= larger * share)
    pairs = pairs.select("old_path", "new_path", larger.alias("larger")).distinct()
    both = pairs.join(a.select(F.col("path").alias("old_path"), "line", "bytes", F.col("n").alias("_a")), "old_path")
    both = both.join(b.select(F.col("path").alias("new_path"), "line", "bytes", F.col("n").alias("_b")), ["new_path", "line", "bytes"])
    kept = both.groupBy("old_path", "new_path", "larger").agg(F.sum(F.least("_a", "_b") * F.col("bytes")).alias("kept"))
    return kept.where(F.col("kept") * 100 >= F.col("larger") * share)


def alike(old: DataFrame, new: DataFrame, share: int = SHARE) -> DataFrame:
    """(old_path, new_path, score, kept): files that share lines of so many percent of the larger one's bytes."""
    return sharing(_lines(old), _lines(new), share).select("old_path", "new_path", F.expr("kept * 100 div larger").alias("score"), "kept")


def name_status(old: DataFrame, new: DataFrame, scope: tuple[str, ...] = (), share: int = SHARE) -> DataFrame:
    """(action, old_path, new_path, score): A, M, D and R, within the scope. Empty files are renamed to none."""
    side = lambda d: d.where(in_scope(F.col("path"), scope)).select("path", F.coalesce("content", F.lit("")).alias("content"))
    old, new = side(old), side(new)
    digest = F.md5(F.col("content").cast("binary")).alias("digest")
    changed = new.select("path", digest).join(old.select("path", F.md5(F.col("content").cast("binary")).alias("was")), "path").where("digest <> was")
    gone, come = old.join(new.select("path"), "path", "left_anti"), new.join(old.select("path"), "path", "left_anti")
    named = lambda d: d.where("content <> ''").select("path", digest)
    most = most_of_one(named(gone).unionByName(named(come)), ["digest"])
    nth = lambda d: numbered(named(d), ["digest"], "path", "nth", most)
    moved = nth(gone).withColumnRenamed("path", "old_path").join(nth(come).withColumnRenamed("path", "new_path"), ["digest", "nth"]).select("old_path", "new_path", F.lit(100).cast("long").alias("score"))
    rest = lambda d, p: d.where("content <> ''").join(moved.select(F.col(p).alias("path")), "path", "left_anti")
    found = alike(rest(gone, "old_path"), rest(come, "new_path"), share)
    best = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.desc("score"), F.desc("kept"), F.asc(other)))
    found = found.withColumn("_a", best("old_path", "new_path")).withColumn("_b", best("new_path", "old_path")).where("_a = 1 and _b = 1")
    renamed = moved.unionByName(found.select("old_path", "new_path", "score"))
    left = lambda d, p: d.select(F.col("path").alias(p)).join(renamed.select(p), p, "left_anti")
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("long").alias("score")
    rows = renamed.select(F.lit("R").alias("action"), "old_path", "new_path", "score")
    rows = rows.unionByName(changed.select(F.lit("M").alias("action"), F.col("path").alias("old_path"), F.col("path").alias("new_path"), zero))
    rows = rows.unionByName(left(come, "new_path").select(F.lit("A").alias("action"), none.alias("old_path"), "new_path", zero))
    return rows.unionByName(left(gone, "old_path").select(F.lit("D").alias("action"), "old_path", none.alias("new_path"), zero))
