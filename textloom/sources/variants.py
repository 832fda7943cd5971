"""Objects whose fields go by other names from version to version: the names are rows of a registry, not code.

A registry is a table (variant, nth, level, role, name, needed): of the variants whose needed names an object of the first
level has, the first counts. Values are then told by role. What fits no variant goes to a side table with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "variant string, nth int, level int, role string, name string, needed boolean, rank int"
MOST_NAMES = 10_000

# Names of the fields of dialogues (talk, its list, and of each entry its id, role, the role's type and id, and
# text), and whether the list's name is needed to tell the variant.
TALK_FIELDS = (
    ("plain", "talkId", "dialogList", "id", "talkRole", "type", "_id", "talkContentTextMapHash", False),
    ("ADHL", "ADHLLDAPKCM", "MOEOFGCKILF", "ILHDNJDDEOP", "LCECPDILLEE", "_type", "_id", "GABLFFECBDO", False),
    ("FEOA", "FEOACBMDCKJ", "AAOAAFLLOJI", "CCFPGAKINNB", "HJLEMJIGNFE", "type", "id", "BDOKCLNNDGN", True),
    ("LBPG", "LBPGKDMGFBN", "LOJEOMAPIIM", "BLKKAMEMBBJ", "HJIPOJOECIF", "_type", "_id", "CMKPOJOEHHA", True),
    ("AADK", "AADKDKPMGNO", "GALIDJOEHOC", "NFIEHACCECI", "PIBKEGJOJHN", "_type", "_id", "AIGJBMCHCJG", True),
    ("KFCN", "KFCNJPJOJLA", "IOEDPLCPFFB", "GMOMCKNPBGE", "DGGDDIMMIDO", "_type", "_id", "HJJLLECCCPI", True),
    ("LDLM", "LDLMECNIJFC", "GDDPNNHLGBL", "ANKFNLMKOII", "EENIFNIGHCH", "_type", "_id", "DMIFDJDEFAL", True),
)
# Names of the fields of voice items (what tells the variant, id, sources, trigger, guid, first name of a path).
VOICE_FIELDS = (
    ("JOMD", "JOMDCMBGNMB", "BKGHEBIGJNC", "NEJBKIJIBHJ", "JOMDCMBGNMB", "LNBFOPNLLDB", None),
    ("guid", "guid", "gameTriggerArgs", "sourceNames", "gameTrigger", "guid", None),
    ("Guid", "Guid", "gameTriggerArgs", "SourceNames", "GameTrigger", "Guid", None),
    ("ABAE", "ABAEBGLPCIK", "MEDGFBMLDDK", "JKDJFGBGOEB", "BHOKINENJBN", "ABAEBGLPCIK", "DCIHFJLBLAP"),
    ("NDLO", "NDLOFEPMEMO", "HEKJMGHIJBM", "JKHGLBHOKIC", "HPIPCKOOMLL", "NDLOFEPMEMO", "BJDAJEKPCFP"),
    ("IACP", "IACPGADBANJ", "MGOMDNKKLCP", "OPGDOEDEJOJ", "IACPGADBANJ", "ABNMMNPAKKP", "MDOCAGOFPAP"),
)
PATH_FIELDS = ("sourceFileName", "NKPOOPONEHG", "MDOCAGOFPAP", "DCIHFJLBLAP", "BJDAJEKPCFP")
SPEAKER_FIELDS = ("avatarName", "FBCCEBGJEDB", "GDIJGLOHHFM", "IEPAMKPOOII", "switchName")


def talk_registry(spark: SparkSession) -> DataFrame:
    rows = []
    for nth, (variant, talk, listed, entry, role, kind, who, text, needed) in enumerate(TALK_FIELDS):
        rows += [(variant, nth, 1, "talk", talk, True, 0), (variant, nth, 1, "entries", listed, needed, 0)]
        rows += [(variant, nth, 2, "entry", entry, True, 0), (variant, nth, 2, "role", role, False, 0), (variant, nth, 2, "text", text, True, 0)]
        rows += [(variant, nth, 3, "kind", kind, False, 0), (variant, nth, 3, "who", who, False, 0)]
    return spark.createDataFrame(rows, REGISTRY)


def voice_registry(spark: SparkSession) -> DataFrame:
    rows = []
    for nth, (variant, tell, entry, sources, trigger, guid, path) in enumerate(VOICE_FIELDS):
        rows += [(variant, nth, 1, "variant", tell, True, 0), (variant, nth, 1, "entry", entry, False, 0), (variant, nth, 1, "sources", sources, False, 0)]
        rows += [(variant, nth, 1, "trigger", trigger, False, 0), (variant, nth, 1, "guid", guid, False, 0)]
        rows += [(variant, nth, 2, "path", name, False, i) for i, name in enumerate(dict.fromkeys((path, *PATH_FIELDS) if path else PATH_FIELDS))]
        rows += [(variant, nth, 2, "speaker", name, False, i) for i, name in enumerate(SPEAKER_FIELDS)]
    return spark.createDataFrame(rows, REGISTRY)


def _checked(registry: DataFrame) -> DataFrame:
    if registry.limit(MOST_NAMES + 1).count() > MOST_NAMES:
        raise ValueError(f"a registry has at most {MOST_NAMES} names")
    return registry


def fields(body: Column) -> Column:
    """The fields of a JSON object as text, nested ones as JSON; null where it is no object."""
    return F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})


def _told(objects: DataFrame, registry: DataFrame, key: str, body: str) -> DataFrame:
    """(key, variant, roles, reason): each object with its variant and a map of role to value, or why it has none. An object is
    compared with the registry where it stands, so none of them is shuffled."""
    first = registry.where("level = 1")
    needed = F.array_compact(F.collect_set(F.when(F.col("needed"), F.col("name"))))
    each = _checked(first).groupBy("nth", "variant").agg(F.collect_list(F.struct("role", "name")).alias("names"), needed.alias("needed"))
    known = each.where(F.size("needed") > 0).agg(F.array_sort(F.collect_list(F.struct("nth", "variant", "names", "needed"))).alias("_known"))
    rows = objects.select(key, fields(F.col(body)).alias("_fields")).crossJoin(F.broadcast(known))
    fits = F.filter("_known", lambda v: F.forall(v["needed"], lambda name: F.map_contains_key("_fields", name)))
    rows = rows.select(key, "_fields", F.get(fits, F.lit(0)).alias("_own"))
    held = F.filter("_own.names", lambda x: F.map_contains_key("_fields", x["name"]))
    roles = F.map_from_entries(F.transform(held, lambda x: F.struct(x["role"], F.element_at("_fields", x["name"]))))
    reason = F.when(F.col("_fields").isNull(), "malformed").when(F.col("_own").isNull(), "no variant")
    return rows.select(key, F.col("_own.variant").alias("variant"), roles.alias("roles"), reason.alias("reason"))


def classified(objects: DataFrame, registry: DataFrame, key: str, body: str) -> tuple[DataFrame, DataFrame]:
    """Objects with a variant, (key, variant, roles), roles a map of role to value; and the others, (key, reason)."""
    told = _told(objects, registry, key, body)
    return told.where("reason is null").select(key, "variant", "roles"), told.where("reason is not null").select(key, "reason")


def _names(registry: DataFrame, level: int) -> DataFrame:
    """(variant, names): of each role its names in order, as a map."""
    one = registry.where(F.col("level") == level).groupBy("variant", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    return F.broadcast(one.groupBy("variant").agg(F.map_from_entries(F.collect_list(F.struct("role", "names"))).alias(f"names{level}")))


def _first(held: Column, names: Column, role: str) -> Column:
    """The first value, not null, of a role's names."""
    return F.get(F.filter(F.transform(F.try_element_at(names, F.lit(role)), lambda n: F.try_element_at(held, n)), lambda v: v.isNotNull()), F.lit(0))


def _long(c: Column) -> Column:
    return F.try_to_number(F.trim(c), F.lit("S999999999999999999")).cast("long")


def talks(objects: DataFrame, key: str = "file", body: str = "body", registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of dialogues, (key, talk, nth, entry, kind, who, text), and the objects that are none, (key, reason).

    An entry without id or text is left out; one without a whole role has who -1. A talk whose id is no number is rejected.
    """
    registry = talk_registry(objects.sparkSession) if registry is None else registry
    found = _told(objects, registry, key, body).withColumn("talk", _long(F.col("roles")["talk"]))
    rest = found.select(key, F.coalesce("reason", F.when(F.col("talk").isNull(), "id")).alias("reason")).where("reason is not null")
    listed = found.where("reason is null and talk is not null").join(_names(registry, 2), "variant", "left").join(_names(registry, 3), "variant", "left")
    each = listed.select(key, "talk", "names2", "names3", F.posexplode(F.from_json(F.try_element_at("roles", F.lit("entries")), "array<string>")).alias("nth", "_entry"))
    own = each.select(key, "talk", "nth", "names2", "names3", fields(F.col("_entry")).alias("_f")).where("_f is not null")
    value = lambda role: _first(F.col("_f"), F.col("names2"), role)
    own = own.select(key, "talk", "nth", _long(value("entry")).alias("entry"), fields(value("role")).alias("_r"), _long(value("text")).alias("text"), "names3")
    inside = lambda role: _first(F.col("_r"), F.col("names3"), role)
    whole = inside("kind").isNotNull() & inside("who").isNotNull()
    rows = own.where("entry is not null and text is not null")
    return rows.select(key, "talk", "nth", "entry", F.when(whole, inside("kind")).alias("kind"), F.when(whole, _long(inside("who"))).otherwise(F.lit(-1)).cast("long").alias("who"), "text"), rest


def voices(objects: DataFrame, key: str = "item", body: str = "body", registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Voice rows of dialogues, (key, entry, trigger, path, speaker), and the objects that are none, (key, reason)."""
    registry = voice_registry(objects.sparkSession) if registry is None else registry
    found = _told(objects, registry, key, body)
    role = lambda name: F.try_element_at("roles", F.lit(name))
    # What tells the variant may also be its trigger, so roles that share a name are read by name.
    trigger = F.lower(F.trim(F.coalesce(role("trigger"), role("variant"))))
    found = found.select(key, "reason", "variant", "roles", trigger.alias("_kind"), F.from_json(role("sources"), "array<string>").alias("_sources"), _long(role("entry")).alias("entry"))
    bad = F.when(F.col("_sources").isNull() | F.col("roles")["entry"].isNull() | (F.coalesce("_kind", F.lit("")) == ""), "missing").when(F.col("_kind") != "dialog", "not dialog").when(F.col("entry").isNull(), "id")
    bad = F.coalesce("reason", bad)
    rest = found.select(key, bad.alias("reason")).where("reason is not null")
    each = found.where(bad.isNull()).join(_names(registry, 2), "variant").select(key, "entry", F.coalesce(role("trigger"), role("variant")).alias("trigger"), "names2", F.explode("_sources").alias("_s"))
    each = each.select(key, "entry", "trigger", "names2", fields(F.col("_s")).alias("_f")).where("_f is not null")
    value = lambda name: _first(F.col("_f"), F.col("names2"), name)
    return each.select(key, "entry", "trigger", value("path").alias("path"), F.lower(value("speaker")).alias("speaker")).where("path <> ''"), rest
