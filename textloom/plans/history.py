"""More queries: histories of texts, full-text terms, placeholders, composite keys, nested conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import groups, history, lineage
from ..sources.catalog import DIALOGUE, TEXT_MAP, VERSION_DIM, Catalog
from .queries import FOLDED, NORM, TIER, query

# Histories. Three snapshots of all documents: texts lose an end sign, then some take another hash.

THREE = (
    "s1 AS (SELECT doc_id AS hash, CASE WHEN n_chars % 9 = 0 THEN text || '!' ELSE text END AS content FROM documents), "
    "s2 AS (SELECT doc_id AS hash, CASE WHEN n_chars % 7 = 0 THEN text || '?' ELSE text END AS content FROM documents WHERE source <> 'src5'), "
    "s3 AS (SELECT CASE WHEN n_chars % 5 < 2 THEN -1 - doc_id ELSE doc_id END AS hash, text AS content FROM documents)"
)


def _step(before: str, rows: str, version: int, name: str) -> str:
    """SQL of one snapshot: name (hash, content, created, updated) from before (the same) and rows (hash, content)."""
    return (
        f"{name}_kept AS (SELECT c.hash FROM {rows} c JOIN {before} o ON c.hash = o.hash AND c.content = o.content), "
        f"{name}_rest AS (SELECT hash, content, row_number() OVER (PARTITION BY content ORDER BY hash) AS nth FROM {rows} WHERE hash NOT IN (SELECT hash FROM {name}_kept)), "
        f"{name}_free AS (SELECT hash, content, row_number() OVER (PARTITION BY content ORDER BY hash) AS nth FROM {before} WHERE hash NOT IN (SELECT hash FROM {name}_kept)), "
        f"{name}_moved AS (SELECT r.hash, f.hash AS previous FROM {name}_rest r JOIN {name}_free f ON r.content = f.content AND r.nth = f.nth), "
        f"{name}_same AS (SELECT hash, hash AS previous FROM {name}_kept UNION ALL SELECT hash, previous FROM {name}_moved), "
        f"{name}_changed AS (SELECT c.hash FROM {rows} c JOIN {before} o ON c.hash = o.hash WHERE c.hash NOT IN (SELECT hash FROM {name}_same) AND c.hash NOT IN (SELECT previous FROM {name}_same)), "
        f"{name} AS (SELECT c.hash, c.content, coalesce(o.created, p.created, {version}) AS created, coalesce(o.updated, {version}) AS updated FROM {rows} c LEFT JOIN {name}_same m ON c.hash = m.hash "
        f"LEFT JOIN {before} o ON o.hash = m.previous LEFT JOIN {name}_changed x ON x.hash = c.hash LEFT JOIN {before} p ON p.hash = x.hash)"
    )


STEPS = f"{THREE}, v1 AS (SELECT hash, content, 1 AS created, 1 AS updated FROM s1), {_step('v1', 's2', 2, 'v2')}, {_step('v2', 's3', 3, 'v3')}"


def _three(c: Catalog) -> list[tuple[int, DataFrame]]:
    docs = c.table("documents")
    marked = lambda n, sign: F.when(F.col("n_chars") % n == 0, F.concat("text", F.lit(sign))).otherwise(F.col("text")).alias("content")
    first = docs.select(F.col("doc_id").alias("hash"), marked(9, "!"))
    second = docs.where("source <> 'src5'").select(F.col("doc_id").alias("hash"), marked(7, "?"))
    third = docs.select(F.when(F.col("n_chars") % 5 < 2, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("hash"), F.col("text").alias("content"))
    return [(1, first), (2, second), (3, third)]


@query(f"WITH {STEPS} SELECT hash, md5(content) AS digest, created::BIGINT AS created, updated::BIGINT AS updated FROM v3")
def replay_versions(c: Catalog) -> DataFrame:
    return history.replay(_three(c)).select("hash", F.md5("content").alias("digest"), "created", "updated")


@query(f"WITH {STEPS} SELECT hash, created::BIGINT AS created, updated::BIGINT AS updated FROM v2")
def row_plan_with_lineage(c: Catalog) -> DataFrame:
    (_, first), (_, second), _ = _three(c)
    one = F.lit(1).cast("long")
    return history.row_plan(second, first.withColumn("created", one).withColumn("updated", one), 2).select("hash", "created", "updated")


@query(f"WITH {STEPS} SELECT n.hash, n.created::BIGINT AS created, n.updated::BIGINT AS updated FROM v2 n LEFT JOIN v1 o ON n.hash = o.hash WHERE o.hash IS NULL OR (n.content, n.created, n.updated) IS DISTINCT FROM (o.content, o.created, o.updated)")
def replay_update_rows(c: Catalog) -> DataFrame:
    (one, first), second, _ = _three(c)
    given = F.lit(one).cast("long")
    before = first.withColumn("created", given).withColumn("updated", given)
    return history.updates(before, history.replay([(one, first), second])).select("hash", "created", "updated")


SUBTITLES = (
    "old AS (SELECT conv_id * 100 + turn AS key, CASE WHEN turn % 3 = 2 THEN text || '!' ELSE text END AS content, 1 + turn % 4 AS created, 4 + turn % 3 AS updated FROM conversations), "
    "new AS (SELECT conv_id * 100 + turn + CASE WHEN role = 'user' THEN 50 ELSE 0 END AS key, text AS content FROM conversations), "
    "held AS (SELECT n.key, n.content = o.content AS same FROM new n JOIN old o ON n.key = o.key), "
    "rest AS (SELECT key, content, row_number() OVER (PARTITION BY content ORDER BY key) AS nth FROM new WHERE key NOT IN (SELECT key FROM held)), "
    "free AS (SELECT key, content, row_number() OVER (PARTITION BY content ORDER BY key) AS nth FROM old WHERE key NOT IN (SELECT key FROM held)), "
    "moves AS (SELECT r.key, f.key AS old_key FROM rest r JOIN free f ON r.content = f.content AND r.nth = f.nth)"
)


def _subtitles(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Lines of before and now: some have another text, and those of users another time."""
    lines, key = c.table("conversations"), F.col("conv_id") * 100 + F.col("turn")
    ended = F.when(F.col("turn") % 3 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = lines.select(key.alias("key"), ended.alias("content"), (1 + F.col("turn") % 4).cast("long").alias("created"), (4 + F.col("turn") % 3).cast("long").alias("updated"))
    return old, lines.select((key + F.when(F.col("role") == "user", 50).otherwise(0)).alias("key"), F.col("text").alias("content"))


@query(
    f"WITH {SUBTITLES}, origin AS (SELECT key, key AS old_key, same FROM held UNION ALL SELECT key, old_key, true FROM moves) SELECT n.key, (CASE WHEN g.same THEN o.created ELSE coalesce(least(o.created, 5), 5) END)::BIGINT AS created, "
    "(CASE WHEN g.same THEN o.updated ELSE coalesce(greatest(o.updated, 5), 5) END)::BIGINT AS updated FROM new n LEFT JOIN origin g ON n.key = g.key LEFT JOIN old o ON o.key = g.old_key"
)
def subtitle_versions(c: Catalog) -> DataFrame:
    old, new = _subtitles(c)
    return history.subtitle_versions(old, new, 5).select("key", "created", "updated")


@query(f"WITH {SUBTITLES} SELECT key FROM new WHERE key NOT IN (SELECT key FROM held WHERE same) AND key NOT IN (SELECT key FROM moves)")
def subtitle_changed_keys(c: Catalog) -> DataFrame:
    old, new = _subtitles(c)
    return history.changed_keys(old, new)


@query(
    f"WITH {SUBTITLES} SELECT n.key, (CASE WHEN n.content = o.content THEN o.created ELSE least(coalesce(o.created, 3), 3) END)::BIGINT AS created, (CASE WHEN n.content = o.content THEN o.updated ELSE 3 END)::BIGINT AS updated FROM new n LEFT JOIN old o ON n.key = o.key"
)
def readable_versions(c: Catalog) -> DataFrame:
    old, new = _subtitles(c)
    return history.readable_versions(old, new, 3).select("key", "created", "updated")


@query(
    "WITH s AS (SELECT user_id AS key, day(ts) AS version, arg_max(event_type, event_id) AS content FROM events GROUP BY 1, 2), b AS (SELECT *, lag(version) OVER (PARTITION BY key ORDER BY version) AS before FROM s), "
    "a AS (SELECT key, max(version) FILTER (before IS NULL OR before < version - 1) AS created, arg_max(content, version) AS now FROM b GROUP BY key) "
    "SELECT a.key, a.created, min(s.version) AS updated FROM a JOIN s ON a.key = s.key AND s.version >= a.created AND s.content = a.now GROUP BY a.key, a.created"
)
def readable_replay(c: Catalog) -> DataFrame:
    days = c.table("events").groupBy(F.col("user_id").alias("key"), F.day("ts").alias("version")).agg(F.max_by("event_type", "event_id").alias("content"))
    return history.appearances(days)


# Filters


@query(
    f"WITH {TEXT_MAP}, {VERSION_DIM} SELECT l.doc_id FROM labels l WHERE EXISTS (SELECT 1 FROM text_map t JOIN version_dim c ON c.id = t.created_version_id JOIN version_dim u ON u.id = t.updated_version_id "
    "WHERE t.hash = l.doc_id AND t.lang = 'en' AND u.version_tag = '2.1' AND lower(trim(coalesce(c.version_tag, c.raw_version, ''))) <> lower(trim(coalesce(u.version_tag, u.raw_version, ''))))"
)
def version_through_hash(c: Catalog) -> DataFrame:
    label = lambda p: F.lower(F.trim(F.coalesce(f"{p}_tag", f"{p}_raw", F.lit(""))))
    dim = lambda p: c.version_dim().select(F.col("id").alias(f"{p}_id"), F.col("version_tag").alias(f"{p}_tag"), F.col("raw_version").alias(f"{p}_raw"))
    texts = c.text_map().where("lang = 'en'").join(F.broadcast(dim("created")), F.col("created_id") == F.col("created_version_id")).join(F.broadcast(dim("updated").where("updated_tag = '2.1'")), F.col("updated_id") == F.col("updated_version_id"))
    texts = texts.where(label("created") != label("updated")).select(F.col("hash").alias("doc_id"))
    return c.table("labels").join(texts, "doc_id", "left_semi").select("doc_id")


@query(f"WITH {TEXT_MAP}, w AS (SELECT hash, string_split_regex({FOLDED}, '\\s+') AS terms FROM text_map WHERE lang = 'en') SELECT hash FROM w WHERE list_contains(terms, 'the') AND list_contains(terms, 'tion') OR array_to_string(terms, ' ') LIKE '%the tion%'")
def fts_all_terms(c: Catalog) -> DataFrame:
    """All terms of the keyword, in any order, or the keyword as it stands."""
    word = "“the tion”"
    terms = text.index_terms(F.col("content"), words=True)
    every = F.forall(F.array(*map(F.lit, text.query_terms(word, words=True))), lambda t: F.array_contains(terms, t))
    phrase = F.contains(F.array_join(F.split(text.fold(F.col("content")), r"\s+"), " "), F.lit(text.keyword(word)))
    return c.text_map().where("lang = 'en'").where(every | phrase).select("hash")


@query(f"WITH {TEXT_MAP}, w AS (SELECT hash, regexp_replace(content, '\\s+', '', 'g') AS whole FROM text_map WHERE lang = 'fr') SELECT hash FROM w WHERE contains(whole, 'le') AND contains(whole, 'eq') AND contains(whole, 'qu')")
def fts_bigrams(c: Catalog) -> DataFrame:
    """A script without spaces: every pair of the keyword's characters, wherever they stand."""
    terms = text.index_terms(F.col("content"), words=False)
    wanted = F.array(*map(F.lit, text.query_terms("l equ", words=False, least=2)))
    return c.text_map().where("lang = 'fr'").where(F.size(F.array_intersect(terms, wanted)) == F.size(wanted)).select("hash")


@query(f"WITH {TEXT_MAP} SELECT hash FROM text_map WHERE list_contains(string_split_regex({FOLDED}, '\\s+'), 'und')")
def fts_stop_words(c: Catalog) -> DataFrame:
    """Stop words, and terms too short or too long, ask for nothing."""
    wanted = text.query_terms("the und a " + "x" * 30, words=True, stop=("the",), least=2, most=20)
    terms = text.index_terms(F.col("content"), words=True)
    return c.text_map().where(F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(terms, t))).select("hash")


@query("SELECT doc_id FROM documents WHERE lang IN ('TextMapFR.json', 'TextFR.json', 'fr', 'FR', 'de', 'DE', 'TextMapDE.json', 'TextDE.json')")
def language_aliases(c: Catalog) -> DataFrame:
    names = {a for lang in ("TextMapfr.json", "de") for a in text.language_aliases(lang)}
    return c.table("documents").where(F.col("lang").isin(*sorted(names))).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (31, -7, 12)")
def int_keywords(c: Catalog) -> DataFrame:
    found = [text.int_keyword(x) for x in ("0x1F", " -7 ", "12", "1.5", "x", None)]
    return c.table("documents").where(F.col("doc_id").isin(*(x for x in found if x is not None))).select("doc_id", "n_chars")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM documents WHERE text LIKE '%tion%' AND lang = 'en') AS hit FROM labels")
def hash_in_keyword(c: Catalog) -> DataFrame:
    hits = c.table("documents").where((F.col("lang") == "en") & F.contains("text", F.lit("tion"))).select(F.col("doc_id").alias("_id")).distinct()
    return c.table("labels").join(hits, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.col("_id").isNotNull().alias("hit"))


SOURCE_KINDS = {"talk": "click", "quest": "view", "readable": "purchase"}


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')")
def source_type_aliases(c: Catalog) -> DataFrame:
    wanted = [SOURCE_KINDS[k] for k in (" Talk".strip().lower(), "readable")]
    return c.table("events").where(F.col("event_type").isin(*wanted)).select("event_id")


# Joins on composite, normalised and linked keys


@query(
    "SELECT l.l_orderkey, l.l_suppkey, p.first FROM lineitem l LEFT JOIN (SELECT l_partkey, l_suppkey, min(l_orderkey) AS first FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) p ON l.l_partkey = p.l_partkey AND l.l_suppkey = p.l_suppkey WHERE l.l_returnflag = 'A'"
)
def composite_key_join(c: Catalog) -> DataFrame:
    lines = c.table("lineitem")
    first = lines.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("first"))
    return lines.where("l_returnflag = 'A'").join(first, ["l_partkey", "l_suppkey"], "left").select("l_orderkey", "l_suppkey", "first")


@query("SELECT p.page_id, d.n FROM (SELECT page_id, 'src' || (page_id % 20) || '_EN.txt' AS file FROM pages) p JOIN (SELECT source || '.txt' AS file, count(*) AS n FROM documents GROUP BY source) d ON regexp_replace(p.file, '_[A-Z]{2,3}(\\.[^.]*)?$', '\\1') = d.file")
def normalised_key_join(c: Catalog) -> DataFrame:
    files = c.table("pages").select("page_id", text.base_name(F.concat(F.lit("a/src"), (F.col("page_id") % 20).cast("string"), F.lit("_EN.txt"))).alias("file"))
    return files.join(c.table("documents").groupBy(F.concat("source", F.lit(".txt")).alias("file")).agg(F.count(F.lit(1)).alias("n")), "file").select("page_id", "n")


@query(f"WITH {DIALOGUE}, link AS (SELECT DISTINCT talk_id, dialogue_id FROM dialogue WHERE turn > 0) SELECT q.talk_id, d.dialogue_id, d.talker_type FROM (SELECT talk_id FROM dialogue WHERE turn = 0) q JOIN link l ON q.talk_id = l.talk_id JOIN dialogue d ON d.dialogue_id = l.dialogue_id")
def link_table_join(c: Catalog) -> DataFrame:
    rows = c.dialogue()
    link = rows.where("turn > 0").select("talk_id", "dialogue_id").distinct()
    return rows.where("turn = 0").select("talk_id").join(link, "talk_id").join(rows.select("dialogue_id", "talker_type"), "dialogue_id").select("talk_id", "dialogue_id", "talker_type")


@query("SELECT c.c_custkey, r.r_name AS title, n.n_name AS context, s.s_name AS locked FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey <> 2 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey AND s.s_acctbal > 0")
def three_role_join(c: Catalog) -> DataFrame:
    nations, suppliers = c.table("nation").where("n_regionkey <> 2"), c.table("supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_name").alias("locked"))
    joined = c.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    joined = joined.join(suppliers, F.col("c_custkey") == F.col("s_suppkey"), "left")
    return joined.select("c_custkey", F.col("r_name").alias("title"), F.col("n_name").alias("context"), "locked")


@query(f"WITH {VERSION_DIM}, qv AS (SELECT o_custkey AS quest, max(o_orderkey % 14 + 1) AS version FROM orders GROUP BY 1) SELECT c_custkey, v.version_tag FROM customer LEFT JOIN qv ON quest = c_custkey LEFT JOIN version_dim v ON v.id = qv.version")
def top_version_lookup(c: Catalog) -> DataFrame:
    newest = c.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderkey") % 14 + 1).alias("id"))
    return c.table("customer").select("c_custkey").join(newest, "c_custkey", "left").join(c.version_dim().select("id", "version_tag"), "id", "left").select("c_custkey", "version_tag")


@query("SELECT e.event_id, s.name FROM events e JOIN (SELECT DISTINCT source AS name, length(source) AS code FROM documents) s ON s.code = length(e.event_type) AND s.code IN (4, 5)")
def entity_source_codes(c: Catalog) -> DataFrame:
    kinds = c.table("documents").select(F.col("source").alias("name"), F.length("source").alias("code")).distinct().where(F.col("code").isin(4, 5))
    return c.table("events").select("event_id", F.length("event_type").alias("code")).join(kinds, "code").select("event_id", "name")


# Texts


MARKED = "CASE turn % 4 WHEN 0 THEN '#Hi {NICKNAME}, {M#he}{F#she} ' WHEN 1 THEN '{PLAYERAVATAR#SEXPRO[P1|P2]} and {MATEAVATAR#SEXPRO[P1|P2]} ' WHEN 2 THEN '#{REALNAME[ID(2)|SHOWHOST(true)]} {REALNAME[ID(1)|HOSTONLY(true)]} ' ELSE '{F#her}{M#him} ' END || text"
SAID = "CASE turn % 4 WHEN 0 THEN 'Hi Traveller, he ' WHEN 1 THEN 'brother and sister ' WHEN 2 THEN 'Little Wanderer ' ELSE 'him ' END || text"


@query(f"SELECT conv_id, turn, {SAID} AS said FROM conversations")
def placeholders_filled(c: Catalog) -> DataFrame:
    marked = c.table("conversations").select("conv_id", "turn", F.expr(MARKED).alias("text"))
    words = F.create_map(F.lit("P1"), F.lit("brother"), F.lit("P2"), F.lit("sister"))
    return marked.select("conv_id", "turn", text.placeholders(F.col("text"), True, F.lit("Wanderer"), F.lit("Traveller"), F.lit("Little"), words).alias("said"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_name || '_XYZ' END AS base FROM customer")
def subtitle_base_names(c: Catalog) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "_EN").otherwise("_XYZ"))
    return c.table("customer").select("c_custkey", F.regexp_replace(name, "_(CHS|CHT|DE|EN|ES|FR|ID|IT|JP|KR|PT|RU|TH|TR|VI)$", "").alias("base"))


@query("SELECT user_id, count(DISTINCT v) AS n FROM (SELECT user_id, try_cast(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS v FROM events) WHERE v > 0 GROUP BY user_id")
def unique_positive_ints(c: Catalog) -> DataFrame:
    value = F.regexp_extract("props", "(-?[0-9]+)", 1).try_cast("long")
    return c.table("events").select("user_id", value.alias("v")).where("v > 0").groupBy("user_id").agg(F.count_distinct("v").alias("n"))


@query("SELECT conv_id AS quest, turn AS talk FROM conversations WHERE role IN ('user', 'system')")
def nested_conditions(c: Catalog) -> DataFrame:
    """steps[].conds[type in a set].params[0], from a quest's JSON."""
    cond = F.struct(F.col("role").alias("type"), F.array(F.col("turn"), F.lit(9).cast("long")).alias("params"))
    quests = c.table("conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.array(cond).alias("conds"))).alias("steps"))).alias("body"))
    parsed = quests.select(F.col("conv_id").alias("quest"), F.from_json("body", "steps array<struct<conds: array<struct<type: string, params: array<bigint>>>>>").alias("b"))
    conds = parsed.select("quest", F.explode("b.steps").alias("s")).select("quest", F.explode("s.conds").alias("x"))
    return conds.where(F.col("x.type").isin("user", "system")).select("quest", F.get("x.params", F.lit(0)).alias("talk"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'a' WHEN event_type = 'view' THEN 'b' ELSE NULL END AS variant FROM events")
def voice_schema(c: Catalog) -> DataFrame:
    """Which set of keys a JSON object has tells its variant."""
    key = F.when(F.col("event_type") == "click", F.lit("sourceFileName")).when(F.col("event_type") == "view", F.lit("SourceNames")).otherwise(F.lit("other"))
    body = c.table("events").select("event_id", F.to_json(F.create_map(key, F.col("event_type"))).alias("body"))
    has = lambda name: F.get_json_object("body", f"$.{name}").isNotNull()
    return body.select("event_id", F.when(has("sourceFileName"), "a").when(has("SourceNames"), "b").alias("variant"))


# Orders and results


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 WHEN role = 'assistant' THEN 1 ELSE 2 END AS field, length(coalesce(text, '')) AS length FROM conversations ORDER BY field, length, conv_id, turn LIMIT 60")
def field_priority_order(c: Catalog) -> DataFrame:
    field = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    rows = c.table("conversations").select("conv_id", "turn", field.alias("field"), F.length(F.coalesce("text", F.lit(""))).alias("length"))
    return rows.orderBy("field", "length", "conv_id", "turn").limit(60)


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) ORDER BY first LIMIT 20 OFFSET 20")
def dedupe_then_page(c: Catalog) -> DataFrame:
    """Distinct first, then the page: nothing is fetched in excess."""
    first = c.table("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return first.orderBy("first").offset(20).limit(20).select("user_id", "event_type")


@query("SELECT DISTINCT text FROM conversations WHERE text LIKE '%the%' ORDER BY text LIMIT 40")
def distinct_by_content(c: Catalog) -> DataFrame:
    return c.table("conversations").where(F.contains("text", F.lit("the"))).select("text").distinct().orderBy("text").limit(40)


@query(f"WITH {TEXT_MAP} SELECT quest, min(updated_version_id) AS updated, count(*) FILTER (created_version_id > updated_version_id) AS odd FROM (SELECT hash % 97 AS quest, * FROM text_map) GROUP BY quest")
def oldest_update(c: Catalog) -> DataFrame:
    odd = F.count_if(F.col("created_version_id") > F.col("updated_version_id"))
    return c.text_map().groupBy((F.col("hash") % 97).alias("quest")).agg(F.min("updated_version_id").alias("updated"), odd.alias("odd"))


@query(
    f"WITH {TEXT_MAP}, hits AS (SELECT hash, {TIER} AS tier, length({NORM}) AS length FROM text_map WHERE contains({FOLDED}, 'the')), names AS (SELECT c_custkey, c_mktsegment FROM customer) "
    "SELECT n.c_mktsegment AS name, count(*) AS n, min(h.tier * 1000000 + h.length) AS best FROM hits h JOIN names n ON n.c_custkey = h.hash + 1 GROUP BY n.c_mktsegment"
)
def name_search(c: Catalog) -> DataFrame:
    content = F.col("content")
    hits = c.text_map().where(text.like_any(content, "the")).select((F.col("hash") + 1).alias("c_custkey"), text.tier(content, "the").alias("tier"), F.length(text.norm(content)).alias("length"))
    named = hits.join(c.table("customer").select("c_custkey", F.col("c_mktsegment").alias("name")), "c_custkey")
    return named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("tier") * 1_000_000 + F.col("length")).alias("best"))


@query(
    f"WITH {TEXT_MAP}, {VERSION_DIM} SELECT t.hash, md5(t.content) AS digest, c.version_tag AS created, u.version_tag AS updated, l.toxic, count(o.o_orderkey) AS sources FROM text_map t LEFT JOIN version_dim c ON c.id = t.created_version_id "
    "LEFT JOIN version_dim u ON u.id = t.updated_version_id LEFT JOIN labels l ON l.doc_id = t.hash LEFT JOIN orders o ON o.o_custkey = t.hash GROUP BY ALL"
)
def hash_detail(c: Catalog) -> DataFrame:
    """All that is known of a text: its versions, its mark and the number of its sources."""
    tag = lambda name: F.broadcast(c.version_dim().select(F.col("id").alias(f"{name}_version_id"), F.col("version_tag").alias(name)))
    sources = c.table("orders").groupBy(F.col("o_custkey").alias("hash")).agg(F.count(F.lit(1)).alias("sources"))
    rows = c.text_map().join(tag("created"), "created_version_id", "left").join(tag("updated"), "updated_version_id", "left")
    rows = rows.join(c.table("labels").select(F.col("doc_id").alias("hash"), "toxic"), "hash", "left").join(sources, "hash", "left")
    return rows.select("hash", F.md5("content").alias("digest"), "created", "updated", "toxic", F.coalesce("sources", F.lit(0)).alias("sources"))


@query(f"WITH {DIALOGUE} SELECT talk_id, dialogue_id FROM dialogue WHERE talker_type = 'assistant' ORDER BY talk_id, dialogue_id LIMIT 30 OFFSET 30")
def speaker_only(c: Catalog) -> DataFrame:
    return c.dialogue().where("talker_type = 'assistant'").select("talk_id", "dialogue_id").orderBy("talk_id", "dialogue_id").offset(30).limit(30)


@query(f"WITH {DIALOGUE} SELECT q.talk_id, d.dialogue_id, d.text, (row_number() OVER (PARTITION BY q.talk_id ORDER BY d.dialogue_id) - 1) // 5 AS page FROM (SELECT DISTINCT talk_id FROM dialogue WHERE talker_type = 'system') q JOIN dialogue d ON q.talk_id = d.talk_id")
def quest_dialogues(c: Catalog) -> DataFrame:
    rows = c.dialogue()
    quests = rows.where("talker_type = 'system'").select("talk_id").distinct()
    nth = F.row_number().over(Window.partitionBy("talk_id").orderBy("dialogue_id")) - 1
    return rows.join(quests, "talk_id", "left_semi").withColumn("nth", nth).select("talk_id", "dialogue_id", "text", F.expr("nth div 5").alias("page"))


@query("SELECT user_id, event_type AS context, min(event_id) AS first FROM events WHERE value > 10 GROUP BY user_id, event_type")
def stories_deduped(c: Catalog) -> DataFrame:
    rows = c.table("events").where("value > 10").select("user_id", F.col("event_type").alias("context"), F.col("event_id").alias("first"))
    return groups.top(rows, ["user_id", "context"], [F.asc("first")])


@query("SELECT item_id AS id, 'benchmark' AS kind FROM benchmark WHERE text LIKE '%the%' UNION ALL SELECT doc_id, 'document' FROM documents WHERE text LIKE '%the%' UNION ALL SELECT page_id, 'page' FROM pages WHERE html LIKE '%the%'")
def text_search_by_kind(c: Catalog) -> DataFrame:
    of = lambda table, key, column, kind: c.table(table).where(F.contains(column, F.lit("the"))).select(F.col(key).alias("id"), F.lit(kind).alias("kind"))
    return of("benchmark", "item_id", "text", "benchmark").unionByName(of("documents", "doc_id", "text", "document")).unionByName(of("pages", "page_id", "html", "page"))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE starts_with(o_orderpriority, '2-') GROUP BY o_custkey")
def prefix_references(c: Catalog) -> DataFrame:
    refs = c.table("orders").where(F.startswith("o_orderpriority", F.lit("2-")))
    return refs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


# Turns of talks against turns of which some have lost their first words and got an end: which share runs of characters.
OLDER = "older AS (SELECT conv_id * 1000 + turn AS hash, CASE WHEN (conv_id + turn) % 3 = 0 AND contains(text, ' ') THEN substr(text, strpos(text, ' ') + 1) || ' and more of it' ELSE text END AS content FROM conversations)"
RUNS = "(SELECT hash, run, count(*) AS n FROM (SELECT hash, substr(content, i, 8) AS run FROM (SELECT *, unnest(range(1, greatest(length(content) - 7, 1) + 1)) AS i FROM {} WHERE content <> '')) GROUP BY ALL)"


@query(
    f"WITH {OLDER}, newer AS (SELECT conv_id * 1000 + turn AS hash, text AS content FROM conversations WHERE turn < 4), a AS {RUNS.format('newer')}, b AS {RUNS.format('older')}, "
    "x AS (SELECT hash, sum(n) AS total FROM a GROUP BY hash), y AS (SELECT hash, sum(n) AS total FROM b GROUP BY hash), "
    "k AS (SELECT a.hash, b.hash AS previous_hash, sum(least(a.n, b.n))::BIGINT AS kept FROM a JOIN b USING (run) GROUP BY ALL) "
    "SELECT k.hash, previous_hash, kept, greatest(x.total, y.total)::BIGINT AS larger FROM k JOIN x ON x.hash = k.hash JOIN y ON y.hash = previous_hash WHERE kept * 100 >= greatest(x.total, y.total) * 25"
)
def lineage_sharing(c: Catalog) -> DataFrame:
    """Pairs of texts that have a quarter of the longer one's runs of eight characters in common."""
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("hash")
    rest = F.substring_index("text", " ", 1)
    cut = (F.col("conv_id") + F.col("turn")) % 3 == 0
    older = c.table("conversations").select(key, F.when(cut & F.contains("text", F.lit(" ")), F.concat(F.substring("text", F.length(rest) + 2, F.length("text")), F.lit(" and more of it"))).otherwise(F.col("text")).alias("content"))
    newer = c.table("conversations").where("turn < 4").select(key, F.col("text").alias("content"))
    return lineage.sharing_grams(newer, older)
