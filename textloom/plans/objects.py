"""Queries over JSON of any shape, objects whose fields have several names, and texts with tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import templates
from ..sources import trees, variants
from ..sources.catalog import Catalog
from .queries import query

# Events as JSON whose strings lie up to seven lists deep; every fiftieth is cut off.
BODY = (
    "body AS (SELECT event_id, '{\"props\":' || props || ',\"deep\":' || repeat('[{\"x\":', (event_id % 7)::INT) || '\"Switch_' || event_type || '\"' || repeat('}]', (event_id % 7)::INT) || "
    "',\"flat\":[\"no\",\"switch_boy\",{\"name\":\"Value #' || event_id % 5 || '\",\"of\":[1.5,true,null]}]' || CASE WHEN event_id % 50 = 0 THEN '' ELSE '}' END AS body FROM events)"
)


def _bodies(c: Catalog) -> DataFrame:
    n = (F.col("event_id") % 7).cast("int")
    body = F.concat(
        F.lit('{"props":'), "props", F.lit(',"deep":'), F.repeat(F.lit('[{"x":'), n), F.lit('"Switch_'), "event_type", F.lit('"'), F.repeat(F.lit("}]"), n),
        F.lit(',"flat":["no","switch_boy",{"name":"Value #'), (F.col("event_id") % 5).cast("string"), F.lit('","of":[1.5,true,null]}]'), F.when(F.col("event_id") % 50 == 0, "").otherwise("}"),
    )
    return c.table("events").select("event_id", body.alias("body"))


@query(
    f"WITH {BODY}, j AS (SELECT event_id, body::JSON AS body FROM body WHERE json_valid(body)) "
    "SELECT text, depth, count(*) AS n FROM (SELECT lower(t.atom ->> '$') AS text, (len(t.fullkey) - len(replace(replace(t.fullkey, '.', ''), '[', '')))::INT AS depth FROM j, json_tree(j.body) t WHERE t.type = 'VARCHAR') "
    "WHERE starts_with(text, 'switch_') AND text <> 'switch_boy' GROUP BY ALL"
)
def json_harvest(c: Catalog) -> DataFrame:
    """Strings of one kind from anywhere inside JSON, at any depth, without the generic ones; broken JSON has none."""
    found = trees.strings_with(trees.nodes(_bodies(c), "event_id", "body"), "switch_", trees.GENERIC_SWITCHES)
    return found.groupBy("text", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BODY} SELECT event_id, 'value' || event_id % 5 AS declared, (event_id % 5)::INT AS named, '[1.5,true,null]' AS held FROM body WHERE json_valid(body)")
def json_declared(c: Catalog) -> DataFrame:
    """Objects inside JSON that declare a name, by that name."""
    found = trees.declared(trees.nodes(_bodies(c), "event_id", "body"), "event_id", "name")
    named = F.regexp_extract(trees.field(F.col("text"), "name"), "[0-9]+", 0).cast("int").alias("named")
    return found.select("event_id", "declared", named, F.to_json(F.try_variant_get(F.parse_json("text"), "$.of", "variant")).alias("held"))


@query(f"WITH {BODY}, j AS (SELECT body::JSON AS body FROM body WHERE json_valid(body)) SELECT CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' ELSE 'other' END AS kind, count(*) AS n FROM j, json_tree(j.body) t GROUP BY ALL")
def json_shapes(c: Catalog) -> DataFrame:
    """How many values of each kind there are."""
    return trees.nodes(_bodies(c), "event_id", "body").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Dialogues as objects in seven variants by their number; every ninth talk is broken, every tenth of no known variant.


def _quoted(name: Column | str, value: Column) -> Column:
    return F.concat(F.lit('"'), F.lit(name) if isinstance(name, str) else name, F.lit('":'), value)


def _talk_objects(c: Catalog) -> DataFrame:
    names = c.spark.createDataFrame([(i, *row[1:8]) for i, row in enumerate(variants.TALK_FIELDS)], "v int, talk string, listed string, entry string, played string, kind string, who string, words string")
    rows = c.table("conversations").withColumn("v", (F.col("conv_id") % 7).cast("int")).join(F.broadcast(names.drop("talk", "listed")), "v")
    role = F.concat(F.lit("{"), _quoted(F.col("kind"), F.concat(F.lit('"'), "role", F.lit('"'))), F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit(","), _quoted(F.col("who"), F.col("turn").cast("string")))), F.lit("}"))
    text = F.when(F.col("turn") == 6, "").otherwise(F.concat(F.lit(","), _quoted(F.col("words"), (F.length("text") * 3).cast("string"))))
    entry = F.concat(F.lit("{"), _quoted(F.col("entry"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string")), F.lit(","), _quoted(F.col("played"), role), text, F.lit("}"))
    listed = rows.groupBy("conv_id", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), ",").alias("entries"))
    own = listed.join(F.broadcast(names.select("v", "talk", "listed")), "v")
    unknown = F.col("conv_id") % 10 == 9
    head = F.concat(F.lit("{"), _quoted(F.when(unknown, "other").otherwise(F.col("talk")), F.col("conv_id").cast("string")), F.lit(","), _quoted(F.col("listed"), F.concat(F.lit("["), "entries", F.lit("]"))))
    return own.select(F.col("conv_id").alias("file"), F.concat(head, F.when(F.col("conv_id") % 9 == 8, "").otherwise("}")).alias("body"))


@query(
    "SELECT conv_id AS file, conv_id AS talk, conv_id * 1000 + turn AS entry, CASE WHEN turn % 5 < 4 THEN role END AS kind, CASE WHEN turn % 5 < 4 THEN turn ELSE -1 END::BIGINT AS who, length(text) * 3 AS text "
    "FROM conversations WHERE turn <> 6 AND conv_id % 9 <> 8 AND conv_id % 10 <> 9"
)
def talk_variants(c: Catalog) -> DataFrame:
    """Entries of dialogues whose fields go by seven sets of names."""
    rows, _ = variants.talks(_talk_objects(c))
    return rows.select("file", "talk", "entry", "kind", "who", "text")


@query("SELECT DISTINCT conv_id AS file, CASE WHEN conv_id % 9 = 8 THEN 'malformed' ELSE 'no variant' END AS reason FROM conversations WHERE conv_id % 9 = 8 OR conv_id % 10 = 9")
def talk_rejects(c: Catalog) -> DataFrame:
    """What the reader cannot take goes to a side table, with a reason."""
    return variants.talks(_talk_objects(c))[1]


def _voice_objects(c: Catalog) -> DataFrame:
    names = c.spark.createDataFrame([(i, tell, entry, sources, trigger, guid, path or "sourceFileName") for i, (_, tell, entry, sources, trigger, guid, path) in enumerate(variants.VOICE_FIELDS)], "v int, tell string, entry string, sources string, trigger string, guid string, path string")
    lines = c.table("lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("p"), "l_returnflag").repartition("item").distinct().withColumn("v", (F.col("item") % 6).cast("int")).join(F.broadcast(names.select("v", "path")), "v")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    path = F.when(F.col("p") % 11 == 0, F.lit('""')).otherwise(text(F.concat(F.lit("vo/"), F.col("p").cast("string"))))
    source = F.concat(F.lit("{"), _quoted(F.col("path"), path), F.lit(","), _quoted("avatarName", text(F.concat(F.lit("Switch_"), "l_returnflag"))), F.lit("}"))
    own = lines.groupBy("item", "v").agg(F.array_join(F.array_sort(F.collect_list(source)), ",").alias("listed")).join(F.broadcast(names.drop("path")), "v")
    kind = F.when(F.col("item") % 4 == 3, "Fetter").otherwise("Dialog")
    guid = F.when(F.col("guid") == F.col("trigger"), F.lit("")).otherwise(F.concat(F.lit(","), _quoted(F.col("guid"), F.lit("1"))))
    number = F.when(F.col("item") % 13 == 0, F.lit('"x"')).otherwise(F.col("item").cast("string"))
    body = F.concat(F.lit("{"), _quoted(F.col("entry"), number), F.lit(","), _quoted(F.col("sources"), F.concat(F.lit("["), "listed", F.lit("]"))), F.lit(","), _quoted(F.col("trigger"), text(kind)), guid, F.lit("}"))
    return own.select("item", body.alias("body"))


@query("SELECT DISTINCT l_orderkey AS item, l_orderkey AS entry, 'vo/' || l_partkey AS path, 'switch_' || lower(l_returnflag) AS speaker FROM lineitem WHERE l_partkey % 11 <> 0 AND l_orderkey % 4 <> 3 AND l_orderkey % 13 <> 0")
def voice_variants(c: Catalog) -> DataFrame:
    """Voice rows whose fields go by six sets of names."""
    return variants.voices(_voice_objects(c))[0].select("item", "entry", "path", "speaker")


@query("SELECT reason, count(*) AS n FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 4 = 3 THEN 'not dialog' ELSE 'id' END AS reason FROM lineitem WHERE l_orderkey % 4 = 3 OR l_orderkey % 13 = 0) GROUP BY reason")
def voice_rejects(c: Catalog) -> DataFrame:
    return variants.voices(_voice_objects(c))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Texts of parts with tokens: names of nations and regions, which name each other, and numbers of pieces.
REFS = (
    "refs AS (SELECT 'K' AS kind, n_nationkey::BIGINT AS ref, n_name || ' of $[C' || n_regionkey || '|x]' AS value FROM nation UNION ALL SELECT 'C', r_regionkey, CASE WHEN r_regionkey = 4 THEN 'far $[K99] $[S7]' ELSE r_name || ' $[S7]' END FROM region UNION ALL SELECT 'S', 7, 'land')"
)
CONTENT = "'$[K' || p_size % 30 || '] and $[C' || p_size % 5 || ']: ' || p_name || ' {PLURAL#' || p_size % 3 || '|piece|pieces} $[Z]'"


@query(
    f"WITH RECURSIVE {REFS}, t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN p_name ELSE {CONTENT} END AS content FROM part), "
    "s(p_partkey, done, rest) AS (SELECT p_partkey, '', content FROM t UNION ALL SELECT p_partkey, "
    "CASE WHEN strpos(rest, '$[') = 0 THEN done || rest WHEN value IS NULL THEN done || substr(rest, 1, strpos(rest, ']')) ELSE done || substr(rest, 1, strpos(rest, '$[') - 1) END, "
    "CASE WHEN strpos(rest, '$[') = 0 THEN '' WHEN value IS NULL THEN substr(rest, strpos(rest, ']') + 1) ELSE value || substr(rest, strpos(rest, ']') + 1) END "
    "FROM s LEFT JOIN refs ON kind = substr(rest, strpos(rest, '$[') + 2, 1) AND ref = try_cast(regexp_extract(substr(rest, strpos(rest, '$[') + 3), '^[0-9]+') AS BIGINT) WHERE rest <> '') "
    r"SELECT s.p_partkey, replace(replace(replace(done, '{PLURAL#0|piece|pieces}', 'pieces'), '{PLURAL#1|piece|pieces}', 'piece'), '{PLURAL#2|piece|pieces}', 'pieces') AS content FROM s JOIN t USING (p_partkey) WHERE rest = '' AND contains(content, '$[')"
)
def token_templates(c: Catalog) -> DataFrame:
    """Texts with the names that their tokens refer to, where these hold tokens too; only what changed."""
    nation, region = c.table("nation"), c.table("region")
    lang = F.lit("en").alias("lang")
    refs = nation.select(F.lit("K").alias("kind"), F.col("n_nationkey").cast("long").alias("ref"), lang, F.concat("n_name", F.lit(" of $[C"), F.col("n_regionkey").cast("string"), F.lit("|x]")).alias("value"))
    place = F.when(F.col("r_regionkey") == 4, "far $[K99] $[S7]").otherwise(F.concat("r_name", F.lit(" $[S7]")))
    refs = refs.unionByName(region.select(F.lit("C").alias("kind"), F.col("r_regionkey").cast("long").alias("ref"), lang, place.alias("value")))
    refs = refs.unionByName(region.limit(1).select(F.lit("S").alias("kind"), F.lit(7).cast("long").alias("ref"), lang, F.lit("land").alias("value")))
    said = lambda n: (F.col("p_size") % n).cast("string")
    content = F.concat(F.lit("$[K"), said(30), F.lit("] and $[C"), said(5), F.lit("]: "), "p_name", F.lit(" {PLURAL#"), said(3), F.lit("|piece|pieces} $[Z]"))
    texts = c.table("part").select("p_partkey", lang, F.when(F.col("p_size") % 7 == 0, F.col("p_name")).otherwise(content).alias("content"))
    return templates.synthetic(texts, ["p_partkey"], refs).select("p_partkey", "content")
