"""Queries of the engine over the logical tables. Each function takes a Catalog; SQL says the same on the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, versions
from ..operators import groups, lineage, merge, search
from ..sources.catalog import DIALOGUE, TEXT_MAP, VERSION_DIM, VOICED, Catalog
from ..streaming import changes

Query = Callable[[Catalog], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}

FOLDED = "translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NORM = "translate(trim(coalesce(content, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TIER = f"CASE WHEN {NORM} = 'the' THEN 0 WHEN starts_with({NORM}, 'the') THEN 1 WHEN contains({NORM}, 'the') THEN 2 ELSE 3 END"
LABELLED = "labelled AS (SELECT id, lower(trim(coalesce(version_tag, raw_version, ''))) AS label, version_tag, version_sort_key FROM version_dim)"


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, path, f=f: f(Catalog(spark, path))) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


# Keyword search


@query(
    f"WITH {TEXT_MAP}, {VOICED} SELECT t.hash, {TIER} AS tier, v.hash IS NOT NULL AS has_voice, length({NORM}) AS length FROM text_map t LEFT JOIN voiced v ON t.hash = v.hash "
    f"WHERE lang = 'en' AND contains({FOLDED}, 'the') ORDER BY tier, has_voice DESC, length, t.hash LIMIT 50"
)
def kw_search_topk(c: Catalog) -> DataFrame:
    content = F.col("content")
    found = search.matches(c.text_map(), "“The”", "en").select("hash", text.tier(content, "the").alias("tier"), F.length(text.norm(content)).alias("length"))
    found = search.with_flag(found, c.voiced(), "hash", "has_voice").select("hash", "tier", "has_voice", "length")
    return search.page(found, [F.asc("tier"), F.desc("has_voice"), F.asc("length"), F.asc("hash")])


@query(f"WITH {TEXT_MAP} SELECT lang, count(*) AS n FROM text_map WHERE contains({FOLDED}, 'thx') OR {FOLDED} LIKE '%t%h%x%' GROUP BY lang")
def kw_search_fuzzy(c: Catalog) -> DataFrame:
    return search.matches(c.text_map(), "t hx", subsequence=True).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEXT_MAP} SELECT lang, count(*) AS n, count(DISTINCT content) AS n_texts FROM text_map WHERE contains({FOLDED}, 'license') GROUP BY lang")
def kw_count_by_lang(c: Catalog) -> DataFrame:
    return search.matches(c.text_map(), "License").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("n_texts"))


@query(f"WITH {TEXT_MAP} SELECT hash FROM text_map WHERE content LIKE '%\\%\\%%' ESCAPE '\\'")
def kw_like_escape(c: Catalog) -> DataFrame:
    return c.text_map().where(F.col("content").like(f"%{text.escaped('%%')}%")).select("hash")


@query(f"WITH {TEXT_MAP} SELECT hash FROM text_map WHERE contains({FOLDED}, 'whing') AND lang IN ('en', 'de')")
def fts_trigram_search(c: Catalog) -> DataFrame:
    # A phrase of three characters or more; for one keyword a scan in generated code costs less than an index of all words.
    return c.text_map().where(F.col("lang").isin("en", "de") & text.like_any(F.col("content"), "whing")).select("hash")


@query(f"WITH {TEXT_MAP} SELECT hash, {TIER} AS tier FROM text_map WHERE contains({FOLDED}, 'the') ORDER BY hash = 7 DESC, tier, hash LIMIT 20 OFFSET 20")
def kw_page_hash_first(c: Catalog) -> DataFrame:
    found = search.matches(c.text_map(), "the").select("hash", text.tier(F.col("content"), "the").alias("tier"))
    return search.page(found, [F.desc(F.col("hash") == 7), F.asc("tier"), F.asc("hash")], 2, 20)


@query(
    "SELECT p_partkey, CASE WHEN lower(p_type) = 'small' THEN 0 WHEN lower(p_type) LIKE 'small%' THEN 1 WHEN lower(p_type) LIKE '%small%' THEN 2 ELSE 3 END AS tier, length(p_type) AS length FROM part ORDER BY tier, length, p_partkey LIMIT 30"
)
def best_field_rank(c: Catalog) -> DataFrame:
    part = c.table("part").withColumn("best", search.best_field([F.col("p_type")], "small"))
    return part.select("p_partkey", "best.tier", "best.length").orderBy("tier", "length", "p_partkey").limit(30)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%HIGH%' ORDER BY o_orderkey = 100 DESC, length(o_orderpriority), o_orderpriority, o_orderkey LIMIT 25")
def exact_id_first(c: Catalog) -> DataFrame:
    found = c.table("orders").where(F.contains("o_orderpriority", F.lit("HIGH"))).select("o_orderkey", "o_orderpriority")
    return found.orderBy(F.desc(F.col("o_orderkey") == 100), F.length("o_orderpriority"), "o_orderpriority", "o_orderkey").limit(25)


# Voices, sources, cascades


@query(f"WITH {TEXT_MAP} SELECT hash FROM text_map t WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.hash AND quality = 1) OR EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = t.hash)")
def has_voice(c: Catalog) -> DataFrame:
    return c.text_map().select("hash").join(c.voiced(), "hash", "left_semi")


@query(f"WITH {TEXT_MAP}, {VOICED} SELECT lang, count(*) AS n FROM text_map t WHERE NOT EXISTS (SELECT 1 FROM voiced v WHERE v.hash = t.hash) GROUP BY lang")
def without_voice(c: Catalog) -> DataFrame:
    return c.text_map().join(c.voiced(), "hash", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


def _sources(c: Catalog) -> list[DataFrame]:
    """Ids with a source, in order of priority."""
    parts = (("labels", "doc_id"), ("conversations", "conv_id"), ("benchmark", "item_id"), ("pages", "page_id"))
    return [c.table(t).select(F.col(k).alias("hash")).distinct() for t, k in parts]


KNOWN = "known AS (SELECT doc_id AS hash FROM labels UNION SELECT conv_id FROM conversations UNION SELECT item_id FROM benchmark UNION SELECT page_id FROM pages)"


@query(f"WITH {TEXT_MAP}, {KNOWN} SELECT t.hash FROM text_map t JOIN known k ON t.hash = k.hash")
def known_source_union(c: Catalog) -> DataFrame:
    first, *rest = _sources(c)
    for more in rest:
        first = first.union(more)
    return c.text_map().select("hash").join(first.distinct(), "hash", "left_semi")


@query(f"WITH {TEXT_MAP}, {KNOWN} SELECT t.hash, lang FROM text_map t WHERE t.hash NOT IN (SELECT hash FROM known) ORDER BY t.hash LIMIT 100 OFFSET 10")
def unknown_source_page(c: Catalog) -> DataFrame:
    first, *rest = _sources(c)
    for more in rest:
        first = first.union(more)
    return c.text_map().select("hash", "lang").join(first, "hash", "left_anti").orderBy("hash").offset(10).limit(100)


@query(
    f"WITH {TEXT_MAP} SELECT t.hash, CASE WHEN l.doc_id IS NOT NULL THEN 'voice' WHEN d.conv_id IS NOT NULL THEN 'dialogue' WHEN b.item_id IS NOT NULL THEN 'entity' WHEN p.page_id IS NOT NULL THEN 'readable' ELSE 'unknown' END AS source "
    "FROM text_map t LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = t.hash LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) d ON d.conv_id = t.hash "
    "LEFT JOIN benchmark b ON b.item_id = t.hash LEFT JOIN pages p ON p.page_id = t.hash"
)
def primary_source_cascade(c: Catalog) -> DataFrame:
    df = c.text_map().select("hash")
    names = ("voice", "dialogue", "entity", "readable")
    for name, ids in zip(names, _sources(c), strict=True):
        df = search.with_flag(df, ids, "hash", name)
    pick = F.lit("unknown")
    for name in reversed(names):
        pick = F.when(F.col(name), name).otherwise(pick)
    return df.select("hash", pick.alias("source"))


@query(
    "WITH parts AS (SELECT c_custkey AS id, 0 AS priority FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT DISTINCT o_custkey, 1 FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_nationkey < 5) "
    "SELECT id, min(priority) AS priority FROM parts GROUP BY id"
)
def keyed_first_wins(c: Catalog) -> DataFrame:
    customer, orders = c.table("customer"), c.table("orders")
    parts = [customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")), orders.where("o_totalprice > 100000").select(F.col("o_custkey").alias("id")), customer.where("c_nationkey < 5").select(F.col("c_custkey").alias("id"))]
    return groups.first_wins(parts, "id", [])


@query("SELECT o_custkey, min(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END) AS priority FROM orders GROUP BY o_custkey")
def source_priority(c: Catalog) -> DataFrame:
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return c.table("orders").groupBy("o_custkey").agg(F.min(order).alias("priority"))


# Versions


@query(f"WITH {TEXT_MAP}, {VERSION_DIM}, {LABELLED} SELECT t.hash FROM text_map t JOIN labelled v ON v.id = t.created_version_id WHERE v.label = '1.4'")
def version_created(c: Catalog) -> DataFrame:
    return search.by_version(c.text_map(), c.version_dim(), created=" 1.4").select("hash")


@query(
    f"WITH {TEXT_MAP}, {VERSION_DIM}, {LABELLED} SELECT t.hash, a.label AS created_label, b.label AS updated_label FROM text_map t LEFT JOIN labelled a ON a.id = t.created_version_id LEFT JOIN labelled b ON b.id = t.updated_version_id "
    "WHERE b.label = '2.0' AND a.label IS DISTINCT FROM b.label"
)
def version_updated_changed(c: Catalog) -> DataFrame:
    return search.by_version(c.text_map(), c.version_dim(), updated="2.0").select("hash", "created_label", "updated_label")


@query(
    "SELECT doc_id, regexp_extract_all(source || 'x' || doc_id || '.' || (n_chars % 7) || '.1 ' || (doc_id % 5) || '.' || (n_chars % 100), '(\\d+\\.\\d+)(?:\\.\\d+)?', 1)[-1] AS tag, "
    "(doc_id % 5) * 1000 + n_chars % 100 AS sort_key FROM documents"
)
def version_tag_last_match(c: Catalog) -> DataFrame:
    raw = F.concat("source", F.lit("x"), "doc_id", F.lit("."), F.col("n_chars") % 7, F.lit(".1 "), F.col("doc_id") % 5, F.lit("."), F.col("n_chars") % 100)
    tagged = c.table("documents").select("doc_id", versions.tag(raw).alias("tag"))
    return tagged.withColumn("sort_key", versions.sort_key(F.col("tag")))


@query(f"WITH {TEXT_MAP}, {VERSION_DIM} SELECT DISTINCT version_tag, version_sort_key FROM version_dim WHERE id IN (SELECT created_version_id FROM text_map) OR id IN (SELECT updated_version_id FROM text_map) ORDER BY version_sort_key DESC")
def version_list(c: Catalog) -> DataFrame:
    texts = c.text_map()
    used = texts.select(F.col("created_version_id").alias("id")).union(texts.select(F.col("updated_version_id").alias("id"))).distinct()
    return c.version_dim().join(used, "id", "left_semi").select("version_tag", "version_sort_key").distinct().orderBy(F.desc("version_sort_key"))


@query(
    f"WITH {TEXT_MAP}, {VERSION_DIM} SELECT lang, raw_version FROM (SELECT lang, created_version_id AS id FROM text_map UNION SELECT lang, updated_version_id FROM text_map WHERE updated_version_id <> created_version_id) u JOIN version_dim USING (id)"
)
def version_catalog_rebuild(c: Catalog) -> DataFrame:
    texts = c.text_map()
    labels = texts.select("lang", F.col("created_version_id").alias("id")).union(texts.where("updated_version_id <> created_version_id").select("lang", F.col("updated_version_id").alias("id")))
    return labels.distinct().join(c.version_dim(), "id").select("lang", "raw_version")


@query("SELECT doc_id, least(doc_id % 9, n_chars % 9) AS created, greatest(doc_id % 9, n_chars % 9) AS updated FROM documents")
def version_preference(c: Catalog) -> DataFrame:
    a, b = F.col("doc_id") % 9, F.col("n_chars") % 9
    return c.table("documents").select("doc_id", versions.prefer(a, b, a, b, True).alias("created"), versions.prefer(a, b, a, b, False).alias("updated"))


@query(f"WITH {TEXT_MAP} SELECT hash, created_version_id, greatest(created_version_id, updated_version_id - 1) AS repaired, updated_version_id < created_version_id + 1 AS fixed FROM text_map")
def version_repair(c: Catalog) -> DataFrame:
    late = F.col("updated_version_id") - 1
    wrong = late < F.col("created_version_id")
    return c.text_map().select("hash", "created_version_id", F.when(wrong, F.col("created_version_id")).otherwise(late).alias("repaired"), wrong.alias("fixed"))


@query(
    "SELECT l_suppkey AS supplier, version FROM (SELECT l_suppkey, l_linenumber AS version, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS nth FROM "
    "(SELECT l_suppkey, l_linenumber, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber)) WHERE nth = 1"
)
def mode_with_tiebreak(c: Catalog) -> DataFrame:
    lines = c.table("lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_linenumber").alias("version"), "l_partkey")
    return groups.mode(lines, ["supplier"], "version", "l_partkey", F.asc("version")).select("supplier", "version")


@query("SELECT key, id FROM (SELECT o_orderpriority AS key, o_custkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey) AS nth FROM orders GROUP BY o_orderpriority, o_custkey) WHERE nth <= 3")
def rank_over_aggregate(c: Catalog) -> DataFrame:
    counts = c.table("orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return groups.numbered(counts, ["key"], [F.desc("n"), F.asc("id")], "nth").where("nth <= 3").select("key", "id")


# Joins


@query("SELECT c_custkey, n_name, r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR c_acctbal < 0")
def star_join(c: Catalog) -> DataFrame:
    joined = c.table("customer").join(c.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where("r_name = 'ASIA' OR c_acctbal < 0").select("c_custkey", "n_name", "r_name", "c_acctbal")


@query("SELECT o_orderkey, p_name FROM orders LEFT JOIN part ON o_orderkey % 3000 = p_partkey AND p_size > 25")
def left_join_condition_in_on(c: Catalog) -> DataFrame:
    orders, part = c.table("orders").select("o_orderkey"), c.table("part").where("p_size > 25")
    return orders.join(part, F.col("o_orderkey") % 3000 == F.col("p_partkey"), "left").select("o_orderkey", "p_name")


@query("SELECT count(*) AS lines, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def anti_join_stats(c: Catalog) -> DataFrame:
    alone = c.table("customer").join(c.table("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return alone.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("c_custkey").alias("customers"))


@query("WITH q AS (SELECT conv_id AS talk, nullif(conv_id % 3, 0) AS scope, role FROM conversations WHERE turn = 0), d AS (SELECT conv_id AS talk, turn % 3 AS scope, turn FROM conversations) SELECT q.talk, q.role, d.turn FROM q JOIN d ON q.talk = d.talk AND coalesce(q.scope, 0) = d.scope")
def scope_join_nullsafe(c: Catalog) -> DataFrame:
    talks = c.table("conversations")
    left = talks.where("turn = 0").select(F.col("conv_id").alias("talk"), F.nullif(F.col("conv_id") % 3, F.lit(0)).alias("a"), "role").withColumn("scope", F.coalesce("a", F.lit(0)))
    right = talks.select(F.col("conv_id").alias("talk"), (F.col("turn") % 3).alias("scope"), "turn")
    return left.join(right, ["talk", "scope"]).select("talk", "role", "turn")


@query("SELECT a.o_orderkey, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND nullif(a.o_orderstatus, 'P') IS NOT DISTINCT FROM nullif(b.o_orderstatus, 'P') AND a.o_orderkey < b.o_orderkey")
def null_safe_join(c: Catalog) -> DataFrame:
    side = lambda p: c.table("orders").select(F.col("o_orderkey").alias(f"{p}key"), F.col("o_custkey").alias(f"{p}cust"), F.nullif("o_orderstatus", F.lit("P")).alias(f"{p}status"))
    a, b = side("a_"), side("b_")
    joined = a.join(b, (F.col("a_cust") == F.col("b_cust")) & F.col("a_status").eqNullSafe(F.col("b_status")) & (F.col("a_key") < F.col("b_key")))
    return joined.select(F.col("a_key").alias("o_orderkey"), F.col("b_key").alias("other"))


@query(
    "SELECT a.event_id, b.event_id AS other FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 60 SECOND AND a.ts + INTERVAL 60 SECOND AND a.event_id <> b.event_id WHERE a.event_type = 'purchase'"
)
def band_join(c: Catalog) -> DataFrame:
    side = lambda p: c.table("events").select(F.col("event_id").alias(f"{p}id"), F.col("user_id").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias(f"{p}at"), F.col("event_type").alias(f"{p}type"))
    width = 60_000_000
    # Buckets of the band's width make the join one of equal keys; each event meets three buckets at most.
    a = side("a_").where("a_type = 'purchase'").withColumn("bucket", F.explode(F.array(*(F.floor(F.col("a_at") / width) + i for i in (-1, 0, 1)))))
    b = side("b_").withColumn("bucket", F.floor(F.col("b_at") / width))
    near = F.abs(F.col("a_at") - F.col("b_at")) <= width
    return a.join(b, ["user_id", "bucket"]).where(near & (F.col("a_id") != F.col("b_id"))).select(F.col("a_id").alias("event_id"), F.col("b_id").alias("other"))


@query(
    "WITH anchor AS (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT e.user_id, count(*) AS n, max(e.event_id) AS latest FROM events e JOIN anchor a ON e.user_id = a.user_id AND e.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY GROUP BY e.user_id"
)
def anchor_band_join(c: Catalog) -> DataFrame:
    events = c.table("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    anchor = events.where("event_type = 'click'").groupBy("user_id").agg(F.min("at").alias("from"))
    near = events.join(anchor, "user_id").where("at BETWEEN `from` AND `from` + 86400000000")
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


@query(
    "WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations) SELECT u.conv_id, u.i, length(u.text) AS asked, length(a.text) AS answered FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.i = a.i AND u.role = 'user' AND a.role = 'assistant'"
)
def positional_align(c: Catalog) -> DataFrame:
    rows = groups.numbered(c.table("conversations"), ["conv_id", "role"], [F.asc("turn")], "i")
    side = lambda role, name: rows.where(F.col("role") == role).select("conv_id", "i", F.length("text").alias(name))
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "i"])


@query(f"WITH {DIALOGUE} SELECT dialogue_id, length(text) AS length FROM dialogue WHERE talker_type = 'user' AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') ORDER BY length, dialogue_id LIMIT 50")
def speaker_and_keyword(c: Catalog) -> DataFrame:
    found = c.dialogue().where((F.col("talker_type") == "user") & text.like_any(F.col("text"), "the"))
    return found.select("dialogue_id", F.length("text").alias("length")).orderBy("length", "dialogue_id").limit(50)


@query(f"WITH {DIALOGUE} SELECT talker_type, count(*) AS n, min(dialogue_id) AS first FROM dialogue GROUP BY talker_type")
def speaker_listing(c: Catalog) -> DataFrame:
    return c.dialogue().groupBy("talker_type").agg(F.count(F.lit(1)).alias("n"), F.min("dialogue_id").alias("first"))


@query(f"WITH {DIALOGUE} SELECT dialogue_id, (row_number() OVER (PARTITION BY talk_id ORDER BY dialogue_id) - 1) // 3 + 1 AS page FROM dialogue")
def talk_page_of_hit(c: Catalog) -> DataFrame:
    rows = groups.numbered(c.dialogue(), ["talk_id"], [F.asc("dialogue_id")], "nth")
    return rows.select("dialogue_id", F.expr("(nth - 1) div 3 + 1").alias("page"))


# Aggregates


@query(
    "WITH g AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS talk, CASE WHEN o_orderstatus = 'P' THEN o_orderkey END AS fallback, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) SELECT count(*) AS groups, sum(n)::BIGINT AS lines, max(n) AS largest, sum(first)::BIGINT AS firsts FROM g"
)
def dialogue_group_counts(c: Catalog) -> DataFrame:
    whole = F.col("o_orderstatus") != "P"
    keyed = c.table("orders").select(F.when(whole, F.col("o_custkey")).alias("talk"), F.when(~whole, F.col("o_orderkey")).alias("fallback"), "o_orderkey")
    each = keyed.groupBy("talk", "fallback").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("lines"), F.max("n").alias("largest"), F.sum("first").alias("firsts"))


@query("SELECT c_mktsegment AS name, c_custkey // 1000 AS chunk, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS ids, count(*) AS n FROM customer GROUP BY c_mktsegment, c_custkey // 1000")
def name_group_listagg(c: Catalog) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    # A name's ids come in chunks, so that no row grows with the table.
    return c.table("customer").groupBy(F.col("c_mktsegment").alias("name"), F.expr("c_custkey div 1000").alias("chunk")).agg(listed.alias("ids"), F.count(F.lit(1)).alias("n"))


@query(
    "SELECT p_type, min(CASE WHEN p_size < 10 THEN p_partkey END) AS first_small, max(CASE WHEN p_size >= 40 THEN p_partkey END) AS last_large, min(p_name) AS title, count(*) FILTER (p_retailprice > 1000) AS dear FROM part GROUP BY p_type"
)
def catalog_conditional_minmax(c: Catalog) -> DataFrame:
    key = F.col("p_partkey")
    return c.table("part").groupBy("p_type").agg(
        F.min(F.when(F.col("p_size") < 10, key)).alias("first_small"), F.max(F.when(F.col("p_size") >= 40, key)).alias("last_large"), F.min("p_name").alias("title"), F.count_if(F.col("p_retailprice") > 1000).alias("dear")
    )


@query("SELECT min(CASE WHEN p_size < 0 THEN p_partkey END) AS first_none, min(p_partkey) AS first, max(p_size) AS largest FROM part WHERE p_partkey = 17")
def entity_version_info(c: Catalog) -> DataFrame:
    return c.table("part").where("p_partkey = 17").agg(F.min(F.when(F.col("p_size") < 0, F.col("p_partkey"))).alias("first_none"), F.min("p_partkey").alias("first"), F.max("p_size").alias("largest"))


@query(
    "WITH u AS (SELECT o_custkey AS quest, 0 AS rank, o_orderpriority AS text FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_custkey, 1, o_orderpriority FROM orders), b AS (SELECT quest, min(rank) AS rank FROM u GROUP BY quest) SELECT b.quest, b.rank, min(u.text) AS text FROM b JOIN u ON u.quest = b.quest AND u.rank = b.rank GROUP BY b.quest, b.rank"
)
def best_rank_min_text(c: Catalog) -> DataFrame:
    orders = c.table("orders").select(F.col("o_custkey").alias("quest"), F.col("o_orderpriority").alias("text"))
    ranked = orders.where(F.startswith("text", F.lit("1"))).withColumn("rank", F.lit(0)).unionByName(orders.withColumn("rank", F.lit(1)))
    return ranked.groupBy("quest").agg(F.min(F.struct("rank", "text")).alias("best")).select("quest", "best.rank", "best.text")


@query("SELECT doc_id % 50 AS hash, max(text) FILTER (lang = 'en') AS en, max(text) FILTER (lang = 'de') AS de, coalesce(max(text) FILTER (lang = 'fr'), max(text) FILTER (lang = 'en'), max(text)) AS shown FROM documents GROUP BY 1")
def lang_pivot(c: Catalog) -> DataFrame:
    of = lambda lang: F.max(F.when(F.col("lang") == lang, F.col("text")))
    docs = c.table("documents").withColumn("hash", F.col("doc_id") % 50)
    return docs.groupBy("hash").agg(of("en").alias("en"), of("de").alias("de"), F.coalesce(of("fr"), of("en"), F.max("text")).alias("shown"))


@query(
    "WITH n AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey) SELECT l_orderkey, sha1(string_agg(l_partkey || ':' || n, '|' ORDER BY l_partkey)) AS signature FROM n GROUP BY l_orderkey"
)
def signature_sha1(c: Catalog) -> DataFrame:
    return groups.signature(c.table("lineitem"), ["l_orderkey"], "l_partkey")


@query("SELECT source, count(*) AS n, count(*) FILTER (length(trim(text)) = 0) AS n_empty, count(*) FILTER (length(trim(text)) < 50) AS n_short, min(doc_id) FILTER (length(trim(text)) < 50) AS sample FROM documents GROUP BY source")
def content_stats(c: Catalog) -> DataFrame:
    size = F.length(F.trim("text"))
    return c.table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(size == 0).alias("n_empty"), F.count_if(size < 50).alias("n_short"), F.min(F.when(size < 50, F.col("doc_id"))).alias("sample"))


@query(f"WITH {TEXT_MAP} SELECT lang, count(*) AS n, count(*) FILTER (updated_version_id > 12) AS n_unversioned, count(*) FILTER (created_version_id > updated_version_id) AS n_reversed, min(updated_version_id) AS first FROM text_map GROUP BY lang")
def quality_counts(c: Catalog) -> DataFrame:
    return c.text_map().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("updated_version_id") > 12).alias("n_unversioned"), F.count_if(F.col("created_version_id") > F.col("updated_version_id")).alias("n_reversed"), F.min("updated_version_id").alias("first"))


@query(
    "SELECT kind, count(*) AS n FROM (SELECT 'short' AS kind FROM documents WHERE n_chars < 60 UNION ALL SELECT 'repeated' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY kind"
)
def anomaly_summary(c: Catalog) -> DataFrame:
    docs = c.table("documents")
    repeated = docs.groupBy("text").count().where("count > 1").select(F.lit("repeated").alias("kind"), F.col("count").alias("n"))
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("n"))
    every = one(docs.where("n_chars < 60"), "short").unionByName(repeated).unionByName(one(docs.join(c.table("labels"), "doc_id", "left_anti"), "unlabelled"))
    return every.groupBy("kind").agg(F.sum("n").alias("n"))


@query("SELECT p_type, count(*) AS n, min(p_partkey) AS sample FROM part WHERE p_type NOT IN ('SMALL', 'LARGE') AND p_size NOT IN (SELECT s_nationkey FROM supplier) GROUP BY p_type")
def unknown_type_profile(c: Catalog) -> DataFrame:
    rest = c.table("part").where(~F.col("p_type").isin("SMALL", "LARGE")).join(c.table("supplier"), F.col("p_size") == F.col("s_nationkey"), "left_anti")
    return rest.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("sample"))


@query("SELECT DISTINCT CASE WHEN p_size >= 27 THEN 5 ELSE p_size % 4 END AS code, p_type FROM part")
def category_pairs(c: Catalog) -> DataFrame:
    return c.table("part").select(F.when(F.col("p_size") >= 27, 5).otherwise(F.col("p_size") % 4).alias("code"), "p_type").distinct()


# Sets


@query("SELECT p_partkey AS id, 'name' AS field, p_name AS value FROM part WHERE p_name <> '' UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_brand <> 'Brand#11'")
def unpivot_pairs(c: Catalog) -> DataFrame:
    pairs = F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("p_name").alias("value")), F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value"))))
    rows = c.table("part").select(F.col("p_partkey").alias("id"), pairs.alias("x")).select("id", "x.field", "x.value")
    return rows.where("(field = 'name' AND value <> '') OR (field = 'brand' AND value <> 'Brand#11')")


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size < 5")
def union_distinct(c: Catalog) -> DataFrame:
    return c.table("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")).union(c.table("part").where("p_size < 5").select("p_partkey")).distinct()


@query("SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def intersect_ids(c: Catalog) -> DataFrame:
    return c.table("orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id")).intersect(c.table("customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_ids(c: Catalog) -> DataFrame:
    return c.table("customer").select(F.col("c_custkey").alias("id")).join(c.table("orders").where("o_totalprice > 300000"), F.col("id") == F.col("o_custkey"), "left_anti").distinct()


@query("SELECT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_linenumber <= 4 EXCEPT ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber > 2")
def bag_difference(c: Catalog) -> DataFrame:
    side = lambda rule: c.table("lineitem").where(rule).select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))
    return groups.bag_difference(side("l_linenumber <= 4"), side("l_linenumber > 2"))


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey, l_partkey")
def dedup_keep_first(c: Catalog) -> DataFrame:
    rows = c.table("lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("first"))
    return groups.top(rows, ["l_orderkey", "l_partkey"], [F.asc("first")])


# Text


@query(
    "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents), a AS (SELECT doc_id, x, strpos(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license') AS pos FROM t WHERE x <> ''), "
    "s AS (SELECT *, greatest(pos - 28, 1) AS b, least(pos + 34, length(x)) AS e FROM a) SELECT doc_id, CASE WHEN pos > 0 THEN (CASE WHEN b > 1 THEN '...' ELSE '' END) || trim(substr(x, b, e - b + 1)) || (CASE WHEN e < length(x) THEN '...' ELSE '' END) "
    "WHEN length(x) <= 72 THEN x ELSE rtrim(substr(x, 1, 69)) || '...' END AS snippet FROM s"
)
def keyword_snippet(c: Catalog) -> DataFrame:
    docs = c.table("documents").where(text.preview(F.col("text")).isNotNull())
    return docs.select("doc_id", text.snippet(F.col("text"), "license").alias("snippet"))


TWIN = "concat('#', p_name, '{M#', p_brand, '}{F#', p_type, '} and {F#x}{M#', p_name, '}')"


@query("SELECT p_partkey, p_name || p_brand || ' and ' || p_name AS male, p_name || p_type || ' and x' AS female, p_name || '{' || p_brand || '/' || p_type || '} and {' || p_name || '/x}' AS both FROM part")
def gender_rewrite(c: Catalog) -> DataFrame:
    part = c.table("part").withColumn("raw", F.expr(TWIN))
    return part.select("p_partkey", *(text.twin_text(F.col("raw"), m).alias(n) for m, n in ((True, "male"), (False, "female"), (None, "both"))))


@query("SELECT c_custkey, array_to_string(list_distinct(list_sort(list_transform(range(1, length(c_name)), lambda i: substr(c_name, i, 2)))), ' ') AS grams FROM customer".replace("list_distinct(list_sort(", "list_sort(list_distinct("))
def char_bigrams(c: Catalog) -> DataFrame:
    return c.table("customer").select("c_custkey", F.array_join(F.array_sort(text.grams(F.col("c_name"), 2)), " ").alias("grams"))


@query("SELECT page_id, regexp_replace(url, '^.*/', '') AS name, length(regexp_replace(html, '\\s+', '', 'g')) AS n FROM pages")
def filename_and_compact(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", text.base_name(F.col("url")).alias("name"), F.length(F.regexp_replace("html", r"\s+", "")).alias("n"))


@query("SELECT doc_id, length(regexp_replace(replace(text || chr(13) || chr(10) || 'x', chr(13) || chr(10), chr(10)), chr(13), chr(10), 'g')) AS n FROM documents")
def line_end_normalise(c: Catalog) -> DataFrame:
    return c.table("documents").select("doc_id", F.length(text.line_ends(F.concat("text", F.lit("\r\nx")))).alias("n"))


@query(
    "WITH t(id, s) AS (SELECT p_partkey, list_extract(['(test)x', '（Test）', '嗯…', '…？', '好的。', '好的', '哈 哈!', '再见~', 'plain', '', '我明白了!!', '什么意思是啊你呢吗'], (p_partkey % 12 + 1)::INT) FROM part) SELECT id, s LIKE '(test)%' OR s LIKE '（Test）%' AS test_text, s IN ('嗯…', '…？', '好的。', '哈 哈!', '再见~', '我明白了!!') AS generic FROM t"
)
def generic_and_test_texts(c: Catalog) -> DataFrame:
    own = ["(test)x", "（Test）", "嗯…", "…？", "好的。", "好的", "哈 哈!", "再见~", "plain", "", "我明白了!!", "什么意思是啊你呢吗"]
    s = F.element_at(F.array(*map(F.lit, own)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return c.table("part").select(F.col("p_partkey").alias("id"), text.is_test_text(s).alias("test_text"), text.is_generic(s).alias("generic"))


@query("SELECT o_orderkey, concat_ws(' · ', nullif(o_orderstatus, 'P'), o_orderpriority, c_name) AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def display_name(c: Catalog) -> DataFrame:
    joined = c.table("orders").join(c.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.concat_ws(" · ", F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority", "c_name").alias("name"))


@query(f"WITH {DIALOGUE} SELECT dialogue_id, CASE talker_type WHEN 'user' THEN 'Player' WHEN 'system' THEN '' ELSE coalesce(c_name, '?') END AS talker FROM dialogue LEFT JOIN customer ON talk_id = c_custkey")
def talker_name(c: Catalog) -> DataFrame:
    joined = c.dialogue().join(c.table("customer"), F.col("talk_id") == F.col("c_custkey"), "left")
    kind = F.col("talker_type")
    return joined.select("dialogue_id", F.when(kind == "user", "Player").when(kind == "system", "").otherwise(F.coalesce("c_name", F.lit("?"))).alias("talker"))


@query("SELECT page_id, CASE WHEN url LIKE 'https://www%' THEN 'www' WHEN url LIKE 'https%' THEN 'secure' WHEN url LIKE 'http%' THEN 'plain' ELSE 'other' END AS category FROM pages")
def prefix_category(c: Catalog) -> DataFrame:
    begins = lambda p: F.startswith("url", F.lit(p))
    return c.table("pages").select("page_id", F.when(begins("https://www"), "www").when(begins("https"), "secure").when(begins("http"), "plain").otherwise("other").alias("category"))


# Bits, JSON


@query("SELECT p_partkey, ((p_size & 255) << 8) | (p_partkey & 255) AS packed, p_size & 255 AS gender, (p_partkey << 16) | (p_size << 8) | 7 AS wide FROM part")
def bit_pack_unpack(c: Catalog) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    packed = F.shiftleft(size.bitwiseAND(255), 8).bitwiseOR(key.bitwiseAND(255))
    part = c.table("part").withColumn("packed", packed)
    return part.select("p_partkey", "packed", F.shiftright("packed", 8).bitwiseAND(255).alias("gender"), F.shiftleft(key, 16).bitwiseOR(F.shiftleft(size, 8)).bitwiseOR(7).alias("wide"))


@query(
    "WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t) "
    "SELECT page_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(url) + 1), lambda i: ascii(url[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS readable_id FROM pages, t"
)
def crc32_ids(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", F.crc32("url").alias("readable_id"))


@query("SELECT event_id, coalesce(nullif(CAST(json_extract_string(props, '$.missing') AS BIGINT), 0), nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 0), -1) AS k FROM events")
def json_first_alias(c: Catalog) -> DataFrame:
    key = lambda p: F.nullif(F.get_json_object("props", p).cast("long"), F.lit(0).cast("long"))
    return c.table("events").select("event_id", F.coalesce(key("$.missing"), key("$.k"), F.lit(-1)).alias("k"))


@query("SELECT p_type, p_size, list_contains([1, 2, 3], p_size)::INT + 2 * list_contains([3, 4], p_size)::INT AS code FROM part GROUP BY p_type, p_size")
def code_from_list(c: Catalog) -> DataFrame:
    held = lambda *x: F.array_contains(F.array(*map(F.lit, x)), F.col("p_size")).cast("int")
    return c.table("part").select("p_type", "p_size").distinct().withColumn("code", held(1, 2, 3) + 2 * held(3, 4))


# Entities


@query(
    "WITH m AS (SELECT p_partkey AS id, field, value FROM (SELECT p_partkey, unnest(['title', 'desc', 'effect']) AS field, unnest([nullif(p_partkey, 0), nullif(p_size % 5, 0), nullif(p_partkey % 3, 0)]) AS value FROM part) WHERE value IS NOT NULL) "
    "SELECT id, field, value, CASE WHEN p_size > 40 THEN 'food' WHEN p_type = 'SMALL' THEN 'material' ELSE 'item' END AS kind FROM m JOIN part ON p_partkey = id"
)
def entity_mappings(c: Catalog) -> DataFrame:
    kind = F.when(F.col("p_size") > 40, "food").when(F.col("p_type") == "SMALL", "material").otherwise("item")
    hashes = {"title": F.col("p_partkey"), "desc": F.col("p_size") % 5, "effect": F.col("p_partkey") % 3}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.cast("long").alias("value")) for k, v in hashes.items())))
    return c.table("part").select(F.col("p_partkey").alias("id"), rows.alias("x"), kind.alias("kind")).select("id", "x.field", "x.value", "kind").where("value <> 0")


@query("SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) OVER (PARTITION BY l_partkey) AS created FROM lineitem")
def entity_created_sync(c: Catalog) -> DataFrame:
    lines = c.table("lineitem")
    first = lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("created"))
    return lines.join(first, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "created")


@query("SELECT ps.p_partkey, p_brand FROM part ps WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R')")
def entity_semi_chain(c: Catalog) -> DataFrame:
    lines = c.table("lineitem").where("l_returnflag = 'R'").join(c.table("orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return c.table("part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


# Merges


def _versions_of(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """An old and a new state of documents."""
    docs = c.table("documents").select(F.col("doc_id").alias("hash"), F.col("n_chars").alias("content"))
    old = docs.where("hash % 5 <> 0").select("hash", "content", (F.col("hash") % 12 + 1).alias("created_version_id"), (F.col("hash") % 12 + 1).alias("updated_version_id"))
    new = docs.where("hash % 3 <> 0").select("hash", (F.col("content") + F.when(F.col("hash") % 7 == 0, 1).otherwise(0)).alias("content"))
    return old, new


STATES = (
    "old AS (SELECT doc_id AS hash, n_chars AS content, doc_id % 12 + 1 AS version FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id AS hash, n_chars + (CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS content FROM documents WHERE doc_id % 3 <> 0)"
)


@query(
    f"WITH {STATES} SELECT coalesce(o.hash, n.hash) AS hash, CASE WHEN n.hash IS NULL THEN o.content ELSE n.content END AS content, CASE WHEN o.hash IS NULL THEN 'insert' WHEN n.hash IS NOT NULL AND o.content IS DISTINCT FROM n.content THEN 'update' ELSE 'keep' END AS action FROM old o FULL JOIN new n ON o.hash = n.hash"
)
def upsert_guarded(c: Catalog) -> DataFrame:
    old, new = _versions_of(c)
    return merge.guarded_upsert(old.select("hash", "content"), new, ["hash"], "content")


@query(
    f"WITH {STATES} SELECT coalesce(o.hash, n.hash) AS hash, CASE WHEN n.hash IS NULL THEN o.content ELSE n.content END AS content, CASE WHEN n.hash IS NULL THEN version ELSE least(coalesce(version, 8), 8) END AS created_version_id, "
    "CASE WHEN o.hash IS NULL THEN 8 WHEN n.hash IS NOT NULL AND o.content IS DISTINCT FROM n.content THEN greatest(version, 8) ELSE version END AS updated_version_id FROM old o FULL JOIN new n ON o.hash = n.hash"
)
def upsert_versioned(c: Catalog) -> DataFrame:
    old, new = _versions_of(c)
    return merge.versioned_upsert(old, new, ["hash"], "content", 8)


@query(f"WITH {STATES} SELECT hash, content FROM old WHERE hash % 2 = 1 OR hash IN (SELECT hash FROM new)")
def prune_unseen(c: Catalog) -> DataFrame:
    old, new = _versions_of(c)
    return merge.prune(old.select("hash", "content"), new, ["hash"], F.col("hash") % 2 == 0)


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 4 <> 1 UNION ALL SELECT conv_id, turn, upper(role) FROM conversations WHERE conv_id % 4 = 1 AND turn < 2")
def replace_scope(c: Catalog) -> DataFrame:
    rows = c.table("conversations").select("conv_id", "turn", "role")
    fresh = rows.where("conv_id % 4 = 1 AND turn < 2").withColumn("role", F.upper("role"))
    return merge.replace_scope(rows, fresh, ["conv_id"])


@query(f"WITH {STATES} SELECT coalesce(o.hash, n.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'A' WHEN n.hash IS NULL THEN 'D' ELSE 'M' END AS status FROM old o FULL JOIN new n ON o.hash = n.hash WHERE o.content IS DISTINCT FROM n.content")
def change_feed(c: Catalog) -> DataFrame:
    old, new = _versions_of(c)
    return merge.name_status(old, new, "hash", "content")


@query(
    "WITH k AS (SELECT DISTINCT source AS label FROM documents), m AS (SELECT max(id) AS top FROM (SELECT unnest(range(1, 15)) AS id)) SELECT label, top + row_number() OVER (ORDER BY label) AS id FROM k, m"
)
def version_dim_extend(c: Catalog) -> DataFrame:
    labels = c.table("documents").select(F.col("source").alias("label")).distinct()
    top = c.version_dim().agg(F.max("id").alias("top")).scalar()
    return labels.withColumn("id", F.row_number().over(Window.orderBy("label")) + top)  # a few labels


# Lineage


def _snapshots(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Current and previous: since then some texts took other hashes, and some lost an end sign."""
    docs = c.table("documents")
    old = docs.select(F.col("doc_id").alias("hash"), F.when(F.col("n_chars") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return docs.select(F.when(F.col("n_chars") % 5 < 2, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("hash"), F.col("text").alias("content")), old


SNAPSHOTS = (
    "old AS (SELECT doc_id AS hash, CASE WHEN n_chars % 9 = 0 THEN text || '!' ELSE text END AS content FROM documents), "
    "cur AS (SELECT CASE WHEN n_chars % 5 < 2 THEN -1 - doc_id ELSE doc_id END AS hash, text AS content FROM documents), "
    "kept AS (SELECT c.hash FROM cur c JOIN old o ON c.hash = o.hash AND c.content = o.content), "
    "rest AS (SELECT hash, content, row_number() OVER (PARTITION BY content ORDER BY hash) AS nth FROM cur WHERE hash NOT IN (SELECT hash FROM kept)), "
    "free AS (SELECT hash, content, row_number() OVER (PARTITION BY content ORDER BY hash) AS nth FROM old WHERE hash NOT IN (SELECT hash FROM kept)), "
    "moved AS (SELECT r.hash, f.hash AS previous_hash FROM rest r JOIN free f ON r.content = f.content AND r.nth = f.nth)"
)


@query(f"WITH {SNAPSHOTS} SELECT hash, hash AS previous_hash, 'same_hash' AS kind FROM kept UNION ALL SELECT hash, previous_hash, 'moved' FROM moved")
def lineage_same_content(c: Catalog) -> DataFrame:
    return lineage.same_content(*_snapshots(c))


@query(
    f"WITH {SNAPSHOTS} SELECT c.hash, c.hash AS previous_hash, 'changed' AS kind FROM cur c JOIN old o ON c.hash = o.hash WHERE c.hash NOT IN (SELECT hash FROM kept) AND c.hash NOT IN (SELECT hash FROM moved) AND c.hash NOT IN (SELECT previous_hash FROM moved)"
)
def lineage_changed(c: Catalog) -> DataFrame:
    current, previous = _snapshots(c)
    return lineage.changed(current, previous, lineage.same_content(current, previous))


@query(None)
def lineage_similar(c: Catalog) -> DataFrame:
    lines = c.dialogue().select(F.col("dialogue_id").alias("hash"), F.col("text").alias("content"))
    # Since then each line has another hash, and words before and after it.
    current = lines.select((-1 - F.col("hash")).alias("hash"), F.concat(F.lit("So "), F.col("content"), F.when(F.col("hash") % 2 == 0, F.lit(" now")).otherwise(F.lit(""))).alias("content"))
    return lineage.similar(current, lines)


@query(
    "WITH s AS (SELECT DISTINCT user_id, day(ts) AS v FROM events), b AS (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY v) AS p FROM s) SELECT user_id, max(v) AS created, min(v) AS first FROM b WHERE p IS NULL OR p < v - 1 GROUP BY user_id"
)
def snapshot_presence(c: Catalog) -> DataFrame:
    return lineage.presence(c.table("events").select("user_id", F.day("ts").alias("v")), "user_id", "v")


@query(
    "WITH x AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS tag FROM orders), f AS (SELECT *, last_value(tag IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS carried FROM x) "
    "SELECT carried AS tag, o_orderkey AS commit FROM (SELECT *, row_number() OVER (PARTITION BY carried ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM f WHERE carried IS NOT NULL) WHERE nth = 1"
)
def snapshot_specs(c: Catalog) -> DataFrame:
    commits = c.table("orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("tag"))
    return groups.latest_of_tag(commits, "o_orderdate", "o_orderkey", "tag").select("tag", F.col("o_orderkey").alias("commit"))


# Streams, as batches


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_rate_limit(c: Catalog) -> DataFrame:
    events = c.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.sliding_count(events, "user_id", "ts", 3600).select("event_id", "n")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def latest_state(c: Catalog) -> DataFrame:
    return groups.top(c.table("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")
