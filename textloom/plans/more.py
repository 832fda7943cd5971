"""Further queries: filters with illegal values, fallbacks, paging of groups, entity rows, deltas and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, versions
from ..operators import groups, search
from ..sources.catalog import DIALOGUE, TEXT_MAP, VERSION_DIM, Catalog
from .queries import query

SOURCE_TYPES = ("F", "O", "P")


def of_type(df: DataFrame, column: str, code: str | None) -> DataFrame:
    """No code: all rows; an illegal one: none."""
    if not code:
        return df
    return df.where(F.col(column) == code) if code in SOURCE_TYPES else df.where(F.lit(False))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus")
def source_type_filter(c: Catalog) -> DataFrame:
    orders = c.table("orders")
    both = of_type(orders, "o_orderstatus", "F").unionByName(of_type(orders, "o_orderstatus", "nothing"))
    return both.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_size IN (5, 6, 27, 28, 29, 30)")
def sibling_codes(c: Catalog) -> DataFrame:
    return c.table("part").where(F.col("p_size").isin(5, 6, *range(27, 31))).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE length(trim(replace(text, '\\n', ''))) >= 100 AND lang = 'fr'")
def valid_content(c: Catalog) -> DataFrame:
    return c.table("documents").where((F.length(F.trim(F.replace("text", F.lit("\\n"), F.lit("")))) >= 100) & (F.col("lang") == "fr")).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment LIKE '%B%' OR c_name LIKE '%9%') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def hidden_without_body(c: Catalog) -> DataFrame:
    hidden = F.contains("c_mktsegment", F.lit("B")) | F.contains("c_name", F.lit("9"))
    bodies = c.table("orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return c.table("customer").where(hidden).join(bodies, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT doc_id, lang || '_' || x AS file FROM documents, (VALUES ('EN'), ('FR'), ('')) t(x)")
def sibling_files(c: Catalog) -> DataFrame:
    suffixes = F.explode(F.array(*map(F.lit, ("EN", "FR", ""))))
    return c.table("documents").select("doc_id", "lang", suffixes.alias("x")).select("doc_id", F.concat_ws("_", "lang", "x").alias("file"))


@query(f"WITH {TEXT_MAP} SELECT 'text' AS kind, count(*) AS n FROM text_map WHERE content LIKE '%the%' UNION ALL SELECT 'page', count(*) FROM pages WHERE html LIKE '%the%' UNION ALL SELECT 'line', count(*) FROM conversations WHERE text LIKE '%the%'")
def counts_by_table(c: Catalog) -> DataFrame:
    of = lambda df, column, kind: df.where(F.contains(column, F.lit("the"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return of(c.text_map(), "content", "text").unionByName(of(c.table("pages"), "html", "page")).unionByName(of(c.table("conversations"), "text", "line"))


@query(f"WITH {TEXT_MAP}, {VERSION_DIM} SELECT lang, arg_min(raw_version, version_sort_key * 100 + id) AS first, arg_max(raw_version, version_sort_key * 100 + id) AS last FROM text_map JOIN version_dim ON id = created_version_id GROUP BY lang")
def group_version_span(c: Catalog) -> DataFrame:
    joined = c.text_map().join(c.version_dim(), F.col("created_version_id") == F.col("id"))
    key = F.struct("version_sort_key", "id")
    return joined.groupBy("lang").agg(F.min_by("raw_version", key).alias("first"), F.max_by("raw_version", key).alias("last"))


@query("SELECT talk, first, n FROM (SELECT conv_id AS talk, min(length(text)) AS first, count(*) AS n FROM conversations GROUP BY conv_id) ORDER BY first, talk LIMIT 20 OFFSET 5")
def group_page_by_aggregate(c: Catalog) -> DataFrame:
    each = c.table("conversations").groupBy(F.col("conv_id").alias("talk")).agg(F.min(F.length("text")).alias("first"), F.count(F.lit(1)).alias("n"))
    return each.orderBy("first", "talk").offset(5).limit(20)


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders ORDER BY nullif(o_orderstatus, 'P') NULLS LAST, o_orderkey OFFSET 12 LIMIT 30")
def nulls_last_page(c: Catalog) -> DataFrame:
    rows = c.table("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return rows.orderBy(F.asc_nulls_last("status"), "o_orderkey").offset(12).limit(30)


@query(
    "WITH d AS (SELECT conv_id, turn, role FROM conversations), scopes AS (SELECT conv_id, count(DISTINCT role) AS n, min(role) AS only_role FROM d GROUP BY conv_id), q AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'system' WHEN turn % 3 = 1 THEN 'user' ELSE 'none' END AS wanted FROM d) "
    "SELECT q.conv_id, q.turn, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.conv_id = q.conv_id AND d.role = q.wanted) THEN wanted WHEN n = 1 THEN only_role END AS scope FROM q JOIN scopes s ON s.conv_id = q.conv_id"
)
def available_scope(c: Catalog) -> DataFrame:
    talks = c.table("conversations").select("conv_id", "turn", "role")
    third = F.col("turn") % 3
    wanted = talks.select("conv_id", "turn", F.when(third == 0, "system").when(third == 1, "user").otherwise("none").alias("wanted"))
    scopes = talks.groupBy("conv_id").agg(F.collect_set("role").alias("roles"))  # a few roles each
    joined = wanted.join(scopes, "conv_id")
    scope = F.when(F.array_contains("roles", F.col("wanted")), F.col("wanted")).when(F.size("roles") == 1, F.get("roles", F.lit(0)))
    return joined.select("conv_id", "turn", scope.alias("scope"))


@query(
    "WITH links AS (SELECT l_orderkey AS quest, l_partkey AS hash, 'dialogue' AS kind FROM lineitem UNION SELECT o_orderkey, o_custkey, 'title' FROM orders) SELECT quest, hash, kind FROM links WHERE hash NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)"
)
def hash_map_refresh(c: Catalog) -> DataFrame:
    lines = c.table("lineitem").select(F.col("l_orderkey").alias("quest"), F.col("l_partkey").alias("hash"), F.lit("dialogue").alias("kind"))
    titles = c.table("orders").select(F.col("o_orderkey").alias("quest"), F.col("o_custkey").alias("hash"), F.lit("title").alias("kind"))
    excluded = c.table("part").where("p_size < 10").select(F.col("p_partkey").alias("hash"))
    return lines.unionByName(titles).distinct().join(excluded, "hash", "left_anti").select("quest", "hash", "kind")


@query("SELECT count(*) AS total, count(*) FILTER (created IS NULL) AS unresolved FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS created FROM orders)")
def unresolved_counts(c: Catalog) -> DataFrame:
    created = F.nullif("o_orderstatus", F.lit("O"))
    return c.table("orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(created.isNull()).alias("unresolved"))


@query("SELECT user_id, arg_max(k, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS k FROM (SELECT user_id, ts, event_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY user_id")
def last_file_wins(c: Catalog) -> DataFrame:
    rows = c.table("events").select("user_id", "ts", "event_id", F.get_json_object("props", "$.k").alias("k"))
    return groups.top(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "k")


@query("SELECT DISTINCT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO' OR p_size = 7))")
def skill_chain(c: Catalog) -> DataFrame:
    parts = c.table("part").where("p_type = 'PROMO' OR p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    lines = c.table("lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("s_suppkey"))
    return c.table("supplier").join(lines, "s_suppkey", "left_semi").select("s_suppkey", "s_name").distinct()


@query("SELECT p_partkey, coalesce(n_name, p_name) AS title FROM part LEFT JOIN nation ON n_nationkey = p_size")
def codex_titles(c: Catalog) -> DataFrame:
    joined = c.table("part").join(c.table("nation"), F.col("p_size") == F.col("n_nationkey"), "left")
    return joined.select("p_partkey", F.coalesce("n_name", "p_name").alias("title"))


@query("SELECT c_custkey AS id, 'old' AS kind FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def entity_delta(c: Catalog) -> DataFrame:
    """What is known already, and what the feed brings besides."""
    old = c.table("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    new = c.table("orders").select(F.col("o_custkey").alias("id")).distinct().join(old, "id", "left_anti")
    return old.withColumn("kind", F.lit("old")).unionByName(new.withColumn("kind", F.lit("new")))


@query(
    "WITH links AS (SELECT DISTINCT l_partkey AS line, l_orderkey AS talk FROM lineitem), gone AS (SELECT o_orderkey AS talk FROM orders WHERE o_orderstatus = 'P') "
    "SELECT line, min(talk) AS was, min(talk) FILTER (talk NOT IN (SELECT talk FROM gone)) AS talk FROM links GROUP BY line"
)
def rehome_shared(c: Catalog) -> DataFrame:
    """Talks are taken away; a line whose home is among them goes to the first talk left that has it, or to none."""
    links = c.table("lineitem").select(F.col("l_partkey").alias("line"), F.col("l_orderkey").alias("talk")).distinct()
    gone = c.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("_gone"))
    kept = links.join(gone, F.col("talk") == F.col("_gone"), "left").withColumn("_stays", F.when(F.col("_gone").isNull(), F.col("talk")))
    return kept.groupBy("line").agg(F.min("talk").alias("was"), F.min("_stays").alias("talk"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS updated FROM orders")
def autofill(c: Catalog) -> DataFrame:
    return c.table("orders").select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("updated"))


@query("SELECT quest, lang, 9 AS version FROM (SELECT DISTINCT l_orderkey AS quest FROM lineitem WHERE l_returnflag = 'R'), (SELECT DISTINCT lang FROM documents)")
def version_delta(c: Catalog) -> DataFrame:
    quests = c.table("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("quest")).distinct()
    langs = c.table("documents").agg(F.collect_set("lang")).scalar()  # the corpus' few languages
    return quests.withColumn("lang", F.explode(langs)).withColumn("version", F.lit(9))


@query("SELECT kind, count(*) AS n, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'texts' WHEN o_orderpriority LIKE '2%' THEN 'quests' ELSE 'rest' END AS kind, o_orderstatus AS status FROM orders) GROUP BY kind")
def diff_routing(c: Catalog) -> DataFrame:
    begins = lambda x: F.startswith("o_orderpriority", F.lit(x))
    kind = F.when(begins("1"), "texts").when(begins("2"), "quests").otherwise("rest")
    return c.table("orders").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("SELECT l_suppkey, l_partkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS paths, min(l_orderkey) AS first FROM lineitem GROUP BY l_suppkey, l_partkey ORDER BY l_suppkey, l_partkey LIMIT 1200")
def dedupe_collect_paths(c: Catalog) -> DataFrame:
    rows = c.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("paths"), F.min("l_orderkey").alias("first"))
    return rows.orderBy("l_suppkey", "l_partkey").limit(1200)


@query(f"WITH {DIALOGUE} SELECT dialogue_id, nth FROM (SELECT dialogue_id, talk_id, row_number() OVER (PARTITION BY talk_id ORDER BY turn) AS nth FROM dialogue) WHERE nth BETWEEN 3 AND 4")
def talk_second_page(c: Catalog) -> DataFrame:
    return groups.numbered(c.dialogue(), ["talk_id"], [F.asc("turn")], "nth").where("nth BETWEEN 3 AND 4").select("dialogue_id", "nth")


@query(f"WITH {TEXT_MAP}, {VERSION_DIM} SELECT lang, max(version_sort_key) AS current, count(DISTINCT version_tag) AS versions FROM text_map JOIN version_dim ON id = updated_version_id GROUP BY lang")
def version_payload(c: Catalog) -> DataFrame:
    joined = c.text_map().join(c.version_dim(), F.col("updated_version_id") == F.col("id"))
    return joined.groupBy("lang").agg(F.max(versions.sort_key(F.col("version_tag"))).alias("current"), F.count_distinct("version_tag").alias("versions"))


@query("SELECT page_id FROM pages WHERE url LIKE '%1%' ORDER BY length(url), url, page_id LIMIT 40")
def file_name_contains(c: Catalog) -> DataFrame:
    found = c.table("pages").where(text.like_any(F.col("url"), "1"))
    return search.page(found, [F.length("url"), F.col("url"), F.col("page_id")], 1, 40).select("page_id")
