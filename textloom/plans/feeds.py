"""Queries over change feeds and over versions as intervals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feeds, groups, intervals
from ..operators.scratch import shared_dir
from ..sources import snapshots
from ..sources.catalog import Catalog
from ..streaming import sinks
from .queries import query

# Two manifests: half of the files move to another folder, some lose their first line, some get one, some go.
OLD = "old AS (SELECT 'docs/' || lang || '/' || doc_id AS path, text AS content FROM documents WHERE source <> 'src3')"
NEW = (
    "new AS (SELECT CASE WHEN n_chars % 2 = 0 THEN 'moved/' || source || '/' || doc_id ELSE 'docs/' || lang || '/' || doc_id END AS path, "
    "CASE WHEN n_chars % 5 = 1 THEN text || chr(10) || 'another line' WHEN n_chars % 5 = 2 AND contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS content FROM documents WHERE source <> 'src5')"
)
STATUS = f"""
WITH {OLD}, {NEW},
gone AS (SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)), come AS (SELECT * FROM new WHERE path NOT IN (SELECT path FROM old)),
g AS (SELECT path, content, row_number() OVER (PARTITION BY content ORDER BY path) AS nth FROM gone WHERE content <> ''),
c AS (SELECT path, content, row_number() OVER (PARTITION BY content ORDER BY path) AS nth FROM come WHERE content <> ''),
moved AS (SELECT g.path AS old_path, c.path AS new_path, 100::BIGINT AS score FROM g JOIN c ON g.content = c.content AND g.nth = c.nth),
gl AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM g WHERE path NOT IN (SELECT old_path FROM moved)) GROUP BY ALL),
cl AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM c WHERE path NOT IN (SELECT new_path FROM moved)) GROUP BY ALL),
gt AS (SELECT path, sum(n * (strlen(line) + 1)) AS total FROM gl GROUP BY path), ct AS (SELECT path, sum(n * (strlen(line) + 1)) AS total FROM cl GROUP BY path),
k AS (SELECT gl.path AS old_path, cl.path AS new_path, sum(least(gl.n, cl.n) * (strlen(line) + 1)) AS kept FROM gl JOIN cl USING (line) GROUP BY 1, 2),
s AS (SELECT old_path, new_path, kept, (kept * 100 // greatest(gt.total, ct.total))::BIGINT AS score FROM k JOIN gt ON gt.path = old_path JOIN ct ON ct.path = new_path WHERE kept * 100 >= greatest(gt.total, ct.total) * 50),
b AS (SELECT old_path, new_path, score FROM s QUALIFY row_number() OVER (PARTITION BY old_path ORDER BY score DESC, kept DESC, new_path) = 1 AND row_number() OVER (PARTITION BY new_path ORDER BY score DESC, kept DESC, old_path) = 1),
r AS (SELECT * FROM moved UNION ALL SELECT * FROM b)
SELECT 'R' AS action, old_path, new_path, score FROM r UNION ALL
SELECT 'M', old.path, old.path, NULL FROM old JOIN new ON old.path = new.path AND old.content <> new.content UNION ALL
SELECT 'A', NULL, path, NULL FROM come WHERE path NOT IN (SELECT new_path FROM r) UNION ALL
SELECT 'D', path, NULL, NULL FROM gone WHERE path NOT IN (SELECT old_path FROM r)
"""


def _manifests(c: Catalog) -> tuple[DataFrame, DataFrame]:
    docs = c.table("documents")
    place = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    old = docs.where("source <> 'src3'").select(place.alias("path"), F.col("text").alias("content"))
    moved = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("moved/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).otherwise(place)
    shorter = F.when((F.col("n_chars") % 5 == 2) & F.contains("text", F.lit("\n")), F.substring_index("text", "\n", 1))
    content = F.when(F.col("n_chars") % 5 == 1, F.concat("text", F.lit("\nanother line"))).when(shorter.isNotNull(), F.substring("text", F.length(shorter) + 2, F.length("text"))).otherwise(F.col("text"))
    return old, docs.where("source <> 'src5'").select(moved.alias("path"), content.alias("content"))


@query(STATUS)
def change_feed_renames(c: Catalog) -> DataFrame:
    return feeds.name_status(*_manifests(c))


@query(STATUS.replace("WHERE source <> 'src3')", "WHERE source <> 'src3' AND lang = 'de')").replace("WHERE source <> 'src5')", "WHERE source <> 'src5' AND (lang = 'de' AND n_chars % 2 = 1 OR source = 'src1' AND n_chars % 2 = 0))"))
def change_feed_scoped(c: Catalog) -> DataFrame:
    """Only what lies in two folders: files that come from elsewhere are new."""
    return feeds.name_status(*_manifests(c), scope=("docs/de", "moved/src1/"))


# Six snapshots of dialogues: lines are missing in some, and their texts change in others.
LINES = (
    "lines AS (SELECT conv_id AS talk, conv_id * 1000 + turn AS line, v AS version, text || CASE WHEN (turn + conv_id + v) % 4 = 0 THEN '!' ELSE '' END AS content "
    "FROM conversations, (SELECT unnest(range(1, 7)) AS v) WHERE (turn * 7 + conv_id * 3 + v * (conv_id % 3)) % 11 > 2 OR v > 3 + conv_id % 3)"
)


def _lines(c: Catalog) -> DataFrame:
    rows = c.table("conversations").withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(6))))
    there = ((F.col("turn") * 7 + F.col("conv_id") * 3 + F.col("version") * (F.col("conv_id") % 3)) % 11 > 2) | (F.col("version") > 3 + F.col("conv_id") % 3)
    mark = F.when((F.col("turn") + F.col("conv_id") + F.col("version")) % 4 == 0, "!").otherwise("")
    return rows.where(there).select(F.col("conv_id").alias("talk"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"), "version", F.concat("text", mark).alias("content"))


MEMBERS = "members AS (SELECT DISTINCT conv_id AS talk, conv_id * 1000 + turn AS line FROM conversations)"
WHOLE = (
    "whole AS (SELECT l.talk, version FROM (SELECT talk, version, count(DISTINCT line) AS n FROM lines GROUP BY ALL) l JOIN (SELECT talk, count(*) AS size FROM members GROUP BY talk) m ON m.talk = l.talk AND n = size), "
    "spans AS (SELECT talk, min(version) AS start, max(version) AS end_ FROM (SELECT talk, version, version - row_number() OVER (PARTITION BY talk ORDER BY version) AS island FROM whole) GROUP BY talk, island)"
)


@query(f"WITH {LINES}, {MEMBERS}, {WHOLE} SELECT talk, start, end_ AS \"end\" FROM spans")
def group_validity(c: Catalog) -> DataFrame:
    """The versions in which every line of a talk was there, as intervals."""
    rows = _lines(c)
    members = c.dialogue().select(F.col("talk_id").alias("talk"), F.col("dialogue_id").alias("line"))
    return intervals.together(members, intervals.lifelines(rows, "line"), "talk", "line")


REPLAY = (
    "born AS (SELECT m.talk, m.line, min(version) AS v FROM members m JOIN lines USING (line) GROUP BY ALL), "
    "vote AS (SELECT talk, v FROM (SELECT talk, v, count(*) AS n FROM born GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY talk ORDER BY n DESC, v) = 1), "
    "changed AS (SELECT a.talk, max(a.version) AS v FROM lines a JOIN lines b ON a.line = b.line AND b.version = a.version - 1 WHERE a.content <> b.content GROUP BY a.talk), "
    "seen AS (SELECT DISTINCT conv_id AS talk, conv_id % 4 + 1 AS v FROM conversations WHERE conv_id % 5 > 0), "
    "replayed AS (SELECT m.talk, greatest(coalesce(w.v, vote.v, seen.v), seen.v) AS created, greatest(coalesce(w.v, vote.v, seen.v), seen.v, changed.v) AS updated, w.v IS NOT NULL AS resolved "
    "FROM (SELECT DISTINCT talk FROM members) m LEFT JOIN (SELECT talk, max(start) AS v FROM spans GROUP BY talk) w ON w.talk = m.talk LEFT JOIN vote ON vote.talk = m.talk LEFT JOIN changed ON changed.talk = m.talk LEFT JOIN seen ON seen.talk = m.talk)"
)


def _replayed(c: Catalog, members: DataFrame) -> DataFrame:
    seen = c.table("conversations").where("conv_id % 5 > 0").select(F.col("conv_id").alias("talk"), (F.col("conv_id") % 4 + 1).alias("version"))
    return intervals.replay_groups(members, _lines(c), seen, "talk", "line", "content")


@query(f"WITH {LINES}, {MEMBERS}, {WHOLE}, {REPLAY} SELECT talk, created::BIGINT AS created, updated::BIGINT AS updated, resolved FROM replayed")
def group_replay(c: Catalog) -> DataFrame:
    """Versions of talks by their lines over six snapshots, with a floor and a repair."""
    members = c.dialogue().select(F.col("talk_id").alias("talk"), F.col("dialogue_id").alias("line"))
    found = _replayed(c, members)
    return found.select("talk", F.col("created").cast("long").alias("created"), F.col("updated").cast("long").alias("updated"), "resolved")


# Texts that are excluded: those of the system, and those that begin with an a.
EXCLUDED = "excluded AS (SELECT conv_id AS talk, conv_id * 1000 + turn AS line FROM conversations WHERE role = 'system' OR starts_with(text, 'A'))"
SIGNED = "SELECT talk, sha1(string_agg(line || ':1', '|' ORDER BY line)) AS signature FROM"


@query(
    f"WITH {EXCLUDED}, m AS (SELECT DISTINCT conv_id AS talk, conv_id * 1000 + turn AS line FROM conversations), "
    f"hit AS (SELECT DISTINCT talk FROM excluded UNION SELECT conv_id FROM conversations WHERE turn = 0 AND length(text) < 200), "
    f"before AS ({SIGNED} m GROUP BY talk), after AS ({SIGNED} m WHERE line NOT IN (SELECT line FROM excluded) GROUP BY talk) "
    "SELECT talk, signature FROM before WHERE talk NOT IN (SELECT talk FROM hit) UNION ALL SELECT talk, signature FROM after WHERE talk IN (SELECT talk FROM hit)"
)
def excluded_texts_repaired(c: Catalog) -> DataFrame:
    """Signatures of the talks that excluded texts touch are computed anew without them; the others stay as they are."""
    rows = c.table("conversations").select(F.col("conv_id").alias("talk"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line"), "role", "text", "turn")
    out = (F.col("role") == "system") | F.startswith("text", F.lit("A"))
    which = intervals.affected([rows.where("role = 'system'"), rows.where(F.startswith("text", F.lit("A"))), rows.where("turn = 0 and length(text) < 200")], "talk")
    signed = lambda d: groups.signature(d.select("talk", "line").distinct(), ["talk"], "line")
    return intervals.repaired(signed(rows), signed(rows.where(~out)), which, "talk")


# Changes of paths along five versions, some of which take a path away; two roots that share paths.
CHANGES = (
    "changes AS (SELECT n_chars % 5 AS version, source || '/' || doc_id % 50 AS path, CASE WHEN n_chars % 7 <> 3 THEN text END AS content FROM documents), "
    "last AS (SELECT path, content, version FROM changes WHERE version <= 3 QUALIFY row_number() OVER (PARTITION BY path ORDER BY version DESC, coalesce(content, '') DESC) = 1)"
)


@query(f"WITH {CHANGES} SELECT path, md5(content) AS digest, version FROM last WHERE content IS NOT NULL AND (starts_with(path, 'src1') OR starts_with(path, 'src2/'))")
def snapshot_as_of(c: Catalog) -> DataFrame:
    """What stood at some paths in a version."""
    docs = c.table("documents")
    place = F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string"))
    changes = docs.select((F.col("n_chars") % 5).alias("version"), place.alias("path"), F.when(F.col("n_chars") % 7 != 3, F.col("text")).alias("content"))
    return snapshots.as_of(changes, 3, ("src1", "src2/")).select("path", F.md5("content").alias("digest"), "version")


@query("SELECT path, arg_min(md5(content), root) AS digest, min(root)::INT AS root FROM (SELECT 'f' || item_id AS path, text AS content, 0 AS root FROM benchmark UNION ALL SELECT 'f' || page_id, html, 1 FROM pages UNION ALL SELECT 'f' || doc_id, text, 2 FROM documents) GROUP BY path")
def roots_first_wins(c: Catalog) -> DataFrame:
    """Paths that several roots have, by the first of them."""
    root = lambda name, key, text: c.table(name).select(F.concat(F.lit("f"), F.col(key).cast("string")).alias("path"), F.col(text).alias("content"))
    rows = snapshots.first_root([root("benchmark", "item_id", "text"), root("pages", "page_id", "html"), root("documents", "doc_id", "text")])
    return rows.select("path", F.md5("content").alias("digest"), "root")


@query("SELECT event_type, count(*) AS n, max(n_users) AS n_users FROM events JOIN (SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type) USING (event_type) WHERE day(ts) <= 20 GROUP BY event_type")
def dual_sink_committed(c: Catalog) -> DataFrame:
    """Batches written to two tables: one is complete, one lacks its row in the log and is not seen, one comes twice."""
    events = c.table("events")
    path = f"{shared_dir(c.spark)}/textloom/sink-{uuid.uuid4().hex}"
    batch = lambda low, high: events.where(F.dayofmonth("ts").between(low, high))
    users = events.select("event_type", "user_id").distinct()
    sinks.commit(c.spark, path, 0, {"events": batch(1, 10).select("event_id", "event_type"), "users": users})
    for _ in range(2):
        sinks.commit(c.spark, path, 1, {"events": batch(11, 20).select("event_id", "event_type"), "users": users.limit(0)})
    batch(21, 31).select("event_id", "event_type").write.parquet(f"{path}/events/batch=2")
    rows = sinks.visible(c.spark, path, "events", "event_id long, event_type string")
    known = sinks.visible(c.spark, path, "users", "event_type string, user_id long").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_users"))
    return rows.join(known, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("n_users").alias("n_users"))
