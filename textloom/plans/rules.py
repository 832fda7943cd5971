"""Queries of rules over paths, names and version marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, text
from ..operators import marks, search
from ..sources.catalog import TEXT_MAP, VERSION_DIM, Catalog
from .queries import FOLDED, query

FILES = r"files AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/Subtitle\' || lang || '/a/b_' || doc_id || '.SRT' WHEN 1 THEN 'Subtitle/' || lang || '/c.txt' WHEN 2 THEN lang || '/d' || doc_id || '.srt/' WHEN 3 THEN lang || '.srt' ELSE 'Readable/' || lang || '/Book' || doc_id || '.txt' END AS path FROM documents)"


def _files(c: Catalog) -> DataFrame:
    n, lang = F.col("doc_id").cast("string"), F.col("lang")
    path = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/Subtitle\\"), lang, F.lit("/a/b_"), n, F.lit(".SRT")))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Subtitle/"), lang, F.lit("/c.txt")))
        .when(F.col("doc_id") % 5 == 2, F.concat(lang, F.lit("/d"), n, F.lit(".srt/")))
        .when(F.col("doc_id") % 5 == 3, F.concat(lang, F.lit(".srt")))
        .otherwise(F.concat(F.lit("Readable/"), lang, F.lit("/Book"), n, F.lit(".txt")))
    )
    return c.table("documents").select("doc_id", path.alias("path"))


@query(f"WITH {FILES} SELECT doc_id, split_part(p, '/', 1) AS lang, substr(p, strpos(p, '/') + 1) AS rest FROM (SELECT doc_id, regexp_replace(regexp_replace(trim(replace(path, chr(92), '/'), '/'), '^Subtitle/', ''), '(?i)\\.srt$', '') AS p, path FROM files) WHERE regexp_matches(path, '(?i)\\.srt/?$') AND contains(p, '/')")
def subtitle_paths(c: Catalog) -> DataFrame:
    """Language and name of subtitle files; other files are rejected."""
    own = _files(c).select("doc_id", paths.subtitle_file(F.col("path")).alias("f")).where("f is not null")
    return own.select("doc_id", "f.lang", "f.rest")


@query(f"WITH {FILES} SELECT doc_id, 'Readable/' || lang || '/' || n || '.txt' AS path FROM (SELECT doc_id, split_part(path, '/', 2) AS lang, replace(split_part(path, '/', 3), '.txt', '') AS n FROM files WHERE starts_with(path, 'Readable/'))")
def readable_paths(c: Catalog) -> DataFrame:
    """Paths taken apart and put together again."""
    own = _files(c).where(F.startswith("path", F.lit("Readable/"))).select("doc_id", paths.under(F.col("path"), "Readable").alias("f"))
    return own.select("doc_id", paths.built("Readable", F.col("f.lang"), F.col("f.rest"), ".txt").alias("path"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 2 THEN NULL ELSE 'a_' || l_suppkey END AS name, CASE WHEN l_partkey % 3 < 2 THEN l_linenumber END AS lang_id, count(*) AS n FROM lineitem GROUP BY ALL")
def subtitle_keys(c: Catalog) -> DataFrame:
    """Name and language of keys in two forms, and of keys that are neither."""
    say = lambda name: F.col(name).cast("string")
    name = F.concat(F.lit("a_"), say("l_suppkey"))
    key = F.when(F.col("l_partkey") % 3 == 0, F.concat_ws("|", name, say("l_linenumber"), F.lit("1.0"), F.lit("2.0"))).when(F.col("l_partkey") % 3 == 1, F.concat_ws("_", name, say("l_linenumber"), F.lit("1.0"), F.lit("2.0"))).otherwise(F.lit("a|b|c"))
    rows = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", paths.key_parts(key).alias("k"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "k.name", "k.lang_id").groupBy("l_orderkey", "l_linenumber", "l_partkey", "name", "lang_id").agg(F.count(F.lit(1)).alias("n"))


# Files named after parts: skins are looked up by number, pieces of sets by set and piece, else by set.
THINGS = (
    "things AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'x/Weapon' || p_partkey || '_EN.txt' WHEN 1 THEN 'wings' || p_partkey || '.txt' WHEN 2 THEN 'Costume' || p_size || '.txt' WHEN 3 THEN 'Relic' || p_size || '_' || p_partkey % 3 || '.txt' ELSE 'Book' || p_partkey || '.txt' END AS path FROM part)"
)


@query(
    f"WITH {THINGS}, k AS (SELECT p_partkey, p_partkey % 5 AS f, p_partkey % 3 AS piece, p_size AS size FROM things JOIN part USING (p_partkey)), skins AS (SELECT n_nationkey AS item, n_nationkey * 100 + 7 AS skin FROM nation), pieces AS (SELECT n_nationkey AS grp, n_regionkey AS piece, n_nationkey * 10 + n_regionkey AS id FROM nation), sets AS (SELECT grp, min(id) AS id FROM pieces GROUP BY grp) "
    "SELECT p_partkey, (CASE f WHEN 0 THEN 9 WHEN 1 THEN 19 WHEN 2 THEN CASE WHEN skin IS NULL THEN 5 ELSE 19 END ELSE 10 END)::INT AS kind, (CASE f WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN coalesce(skin, size) ELSE coalesce(p.id, s.id) END)::BIGINT AS id "
    "FROM k LEFT JOIN skins ON f = 2 AND item = size LEFT JOIN pieces p ON f = 3 AND p.grp = size AND p.piece = k.piece LEFT JOIN sets s ON f = 3 AND s.grp = size WHERE f < 3 OR f = 3 AND coalesce(p.id, s.id) IS NOT NULL"
)
def things_of_files(c: Catalog) -> DataFrame:
    """The thing that a file is named after, by four patterns and three lookups."""
    say = lambda name: F.col(name).cast("string")
    f = F.col("p_partkey") % 5
    path = F.when(f == 0, F.concat(F.lit("x/Weapon"), say("p_partkey"), F.lit("_EN.txt"))).when(f == 1, F.concat(F.lit("wings"), say("p_partkey"), F.lit(".txt"))).when(f == 2, F.concat(F.lit("Costume"), say("p_size"), F.lit(".txt")))
    path = path.when(f == 3, F.concat(F.lit("Relic"), say("p_size"), F.lit("_"), (F.col("p_partkey") % 3).cast("string"), F.lit(".txt"))).otherwise(F.concat(F.lit("Book"), say("p_partkey"), F.lit(".txt")))
    rows = c.table("part").select("p_partkey", paths.thing(path).alias("t")).where("t is not null").select("p_partkey", "t.*")
    nation = c.table("nation")
    skins = nation.select(F.lit(5).alias("kind"), F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 100 + 7).cast("long").alias("skin"))
    pieces = nation.select(F.lit(10).alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("piece"), (F.col("n_nationkey") * 10 + F.col("n_regionkey")).cast("long").alias("own"))
    sets = pieces.groupBy("kind", "id").agg(F.min("own").alias("whole"))
    joined = rows.join(skins, ["kind", "id"], "left").join(pieces, ["kind", "id", "piece"], "left").join(sets, ["kind", "id"], "left")
    found = F.when(F.col("kind") == 10, F.coalesce("own", "whole")).otherwise(F.coalesce("skin", "id"))
    return joined.select("p_partkey", F.when(F.col("skin").isNotNull(), 19).otherwise(F.col("kind")).alias("kind"), found.alias("id")).where("id is not null")


@query("WITH f AS (SELECT page_id, 'Readable/' || page_id % 40 || CASE WHEN page_id % 2 = 0 THEN '_EN' ELSE '' END || '.txt' AS base FROM pages), v AS (SELECT page_id, unnest([split_part(base, '/', 2), replace(split_part(base, '/', 2), '.txt', ''), replace(split_part(base, '/', 2), '_EN', ''), replace(replace(split_part(base, '/', 2), '_EN', ''), '.txt', '')]) AS name FROM f) SELECT name, max(page_id) AS page_id FROM v GROUP BY name")
def file_name_map(c: Catalog) -> DataFrame:
    """Four names of each file lead to it; of files that share a name the later counts."""
    n = F.col("page_id")
    path = F.concat(F.lit("Readable/"), (n % 40).cast("string"), F.when(n % 2 == 0, "_EN").otherwise(""), F.lit(".txt"))
    rows = c.table("pages").select("page_id", F.explode(paths.name_variants(path)).alias("name"))
    return marks.last_of(rows, ["name"], "page_id").select("name", "page_id")


@query("SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'str' WHEN 1 THEN 'int' WHEN 2 THEN 'bool' WHEN 3 THEN 'json' ELSE 'none' END AS kind, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN (user_id % 2)::VARCHAR WHEN 3 THEN user_id || event_type ELSE '' END AS value FROM events) GROUP BY kind")
def typed_keys(c: Catalog) -> DataFrame:
    """Values of several types, told apart by type and value; objects with their fields in another order are the same."""
    n = F.col("event_id") % 5
    user, kind = F.col("user_id").cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    obj = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b":'), user, F.lit(',"a":'), kind, F.lit("}"))).otherwise(F.concat(F.lit('{ "a": '), kind, F.lit(', "b": '), user, F.lit("}")))
    value = F.when(n == 0, kind).when(n == 1, user).when(n == 2, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")).when(n == 3, obj).otherwise(F.lit("null"))
    rows = c.table("events").select(text.typed_key(value).alias("k")).select("k.kind", "k.value")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query("WITH n AS (SELECT regexp_replace(lower(p_name || '！' || p_brand), '[^a-z0-9]+', '', 'g') AS name, count(*) AS n FROM part GROUP BY 1) SELECT name, n FROM n")
def item_names(c: Catalog) -> DataFrame:
    """Names in wide letters and with signs are the names in plain ones."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    name = text.item_name(F.concat(F.when(F.col("p_partkey") % 2 == 0, wide).otherwise(F.col("p_name")), F.lit("！"), "p_brand"))
    return c.table("part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


SPEAKERS = "speakers AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN ' Éva ' WHEN 1 THEN 'ÉVALIN' WHEN 2 THEN 'Old éva' ELSE 'Bob' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_suppkey::VARCHAR END AS name FROM supplier)"


@query(f"WITH {SPEAKERS}, m AS (SELECT id, lower(trim(name)) AS name FROM speakers) SELECT id, CASE WHEN name = 'éva' THEN 0 WHEN starts_with(name, 'éva') THEN 1 WHEN contains(name, 'éva') THEN 2 ELSE 3 END AS tier FROM m")
def speaker_tiers(c: Catalog) -> DataFrame:
    """Names against a keyword in any script's lower case."""
    return _speakers(c).select("id", text.spoken_tier(F.col("name"), " ÉVA").alias("tier"))


def _speakers(c: Catalog) -> DataFrame:
    n = F.col("s_suppkey")
    name = F.when(n % 4 == 0, " Éva ").when(n % 4 == 1, "ÉVALIN").when(n % 4 == 2, "Old éva").otherwise("Bob")
    return c.table("supplier").select(n.alias("id"), F.concat(name, F.when(n % 3 == 0, "").otherwise(n.cast("string"))).alias("name"))


@query(
    f"WITH {SPEAKERS}, {TEXT_MAP}, {VERSION_DIM}, lines AS (SELECT DISTINCT l_suppkey AS speaker, l_partkey AS hash FROM lineitem), "
    f"hits AS (SELECT id, {FOLDED.replace('content', 'trim(name)')} AS name FROM speakers WHERE contains({FOLDED.replace('content', 'name')}, 'bob')) "
    "SELECT l.hash, hits.id FROM hits JOIN lines l ON speaker = hits.id JOIN text_map t ON t.hash = l.hash JOIN version_dim c ON c.id = t.created_version_id WHERE t.lang = 'en' AND c.version_tag = '1.3' "
    "ORDER BY CASE WHEN name = 'bob' THEN 0 WHEN starts_with(name, 'bob') THEN 1 ELSE 2 END, length(name), hits.id, l.hash LIMIT 60"
)
def lines_by_speaker(c: Catalog) -> DataFrame:
    """Lines in a language and version, of the speakers whose name matches; the best names first."""
    name = F.col("name")
    speakers = _speakers(c).where(text.like_any(name, "Bob")).select("id", text.tier(name, "bob").alias("tier"), F.length(text.norm(name)).alias("length"))
    lines = c.table("lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("hash")).distinct()
    texts = search.by_version(c.text_map().where("lang = 'en'"), c.version_dim().withColumn("raw_version", F.col("version_tag")), created="1.3").select("hash")
    found = lines.join(speakers, "id").join(texts, "hash", "left_semi")
    return search.page(found, [F.asc("tier"), F.asc("length"), F.asc("id"), F.asc("hash")], 1, 60).select("hash", "id")


@query("SELECT o_orderkey AS id, CASE WHEN f IS NOT NULL AND (v IS NULL OR f < v) THEN f ELSE v END AS created FROM (SELECT o_orderkey, nullif(o_custkey % 7, 0)::BIGINT AS f, nullif(o_orderkey % 5, 0)::BIGINT AS v FROM orders)")
def created_floors(c: Catalog) -> DataFrame:
    """The version in which a thing was first seen, where that is the earlier one or the only one."""
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), F.nullif(F.col("o_custkey") % 7, F.lit(0)).cast("long").alias("floor"), F.nullif(F.col("o_orderkey") % 5, F.lit(0)).cast("long").alias("created"))
    return marks.floored(rows, "floor", "created", c.version_dim().select(F.col("id"), "version_sort_key")).select("id", "created")


@query("WITH old AS (SELECT o_custkey AS id, min(o_orderkey) AS value, nullif(min(o_orderkey) % 6, 0)::BIGINT AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT o_custkey AS id, max(o_orderkey) AS value, nullif(max(o_orderkey) % 9, 0)::BIGINT AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(new.id, old.id) AS id, coalesce(new.value, old.value) AS value, least(old.v, new.v) AS created FROM old FULL JOIN new ON old.id = new.id")
def earliest_versions(c: Catalog) -> DataFrame:
    """Newer values, each with the earlier of both versions."""
    orders = c.table("orders")
    side = lambda status, pick, n: orders.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("id")).agg(pick("o_orderkey").alias("value")).withColumn("created", F.nullif(F.col("value") % n, F.lit(0)).cast("long"))
    return marks.earliest(side("F", F.min, 6), side("O", F.max, 9), "id", "value", "created", c.version_dim().select("id", "version_sort_key"))


@query("WITH x AS (SELECT o_orderkey AS nth, 'v' || o_orderkey % 13 AS version, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'M' ELSE 'A' END AS action, 'f' || o_custkey AS path FROM orders) SELECT path, arg_min(version, nth) AS created, arg_max(version, nth) AS updated, arg_max(action, nth) AS action FROM x GROUP BY path")
def file_versions(c: Catalog) -> DataFrame:
    """When each path came, and what happened to it last."""
    path = F.concat(F.lit("f"), F.col("o_custkey").cast("string"))
    action = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "M").otherwise("A")
    rows = c.table("orders").select(F.col("o_orderkey").alias("nth"), F.concat(F.lit("v"), (F.col("o_orderkey") % 13).cast("string")).alias("version"), action.alias("action"), path.alias("p"))
    return marks.file_versions(rows.select("nth", "version", "action", F.when(F.col("action") == "D", F.col("p")).alias("old_path"), F.when(F.col("action") != "D", F.col("p")).alias("new_path")))


@query("SELECT doc_id AS hash, CASE WHEN lang = 'de' THEN NULL ELSE doc_id % 12 + 1 END AS created_version_id, CASE WHEN lang = 'de' THEN NULL ELSE doc_id % 12 + 1 + n_chars % 3 END AS updated_version_id FROM documents")
def marks_reset(c: Catalog) -> DataFrame:
    """One language's texts without versions, to be followed anew."""
    return marks.reset(c.text_map(), ("created_version_id", "updated_version_id"), F.col("lang") == "de").select("hash", "created_version_id", "updated_version_id")


@query(
    "WITH k AS (SELECT o_orderkey AS sha, CASE o_orderkey % 4 WHEN 0 THEN 'Build 4.0.1 done' WHEN 1 THEN 'No number' WHEN 2 THEN 'OSREL3.' || o_orderkey % 9 || '.0' ELSE 'Win4.0 ' END AS title FROM orders) "
    "SELECT tag, count(*) AS n FROM (SELECT CASE WHEN sha % 4 = 1 THEN NULL WHEN sha % 10 = 2 THEN '9.9' WHEN sha % 4 = 0 THEN '4.1' WHEN sha % 4 = 2 THEN '3.' || sha % 9 ELSE '4.0' END AS tag FROM k) GROUP BY tag"
)
def labels_overridden(c: Catalog) -> DataFrame:
    """Versions of commits by their titles, some of which a table corrects."""
    orders = c.table("orders")
    n = F.col("o_orderkey")
    title = F.when(n % 4 == 0, "Build 4.0.1 done").when(n % 4 == 1, "No number").when(n % 4 == 2, F.concat(F.lit("OSREL3."), (n % 9).cast("string"), F.lit(".0"))).otherwise("Win4.0 ")
    commits = orders.select(n.cast("string").alias("sha"), title.alias("title"))
    overrides = orders.where(n % 10 == 2).select(n.cast("string").alias("sha"), F.lit("9.9").alias("tag"))
    return marks.labelled(commits, overrides).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VERSION_DIM}, d AS (SELECT DISTINCT doc_id % 12 + 1 AS v FROM documents), s AS (SELECT row_number() OVER (ORDER BY version_sort_key) - 1 AS nth, version_tag AS tag FROM version_dim JOIN d ON v = id) SELECT nth, tag, CASE WHEN nth = (SELECT nth FROM s WHERE tag = '1.3') THEN 'base' ELSE 'replay' END AS role FROM s WHERE nth BETWEEN (SELECT nth FROM s WHERE tag = '1.3') AND (SELECT nth FROM s WHERE tag = '2.1')")
def history_range(c: Catalog) -> DataFrame:
    """The snapshots to replay from one version to another, and the one that they start from."""
    used = c.text_map().select(F.col("created_version_id").alias("id")).distinct()
    dim = c.version_dim().join(used, "id")
    rows = dim.select((F.row_number().over(Window.orderBy("version_sort_key")) - 1).cast("long").alias("nth"), F.col("version_tag").alias("tag"))  # a row for each version
    return marks.replay_range(rows, "2.1", "1.3")
