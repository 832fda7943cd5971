"""JSON of any shape and depth as rows: every value with its place, by opening one level after another until none is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import written

#: Names that stand for no one in particular (fixed values).
GENERIC_SWITCHES = ("switch_boy", "switch_girl", "switch_male", "switch_female", "switch_loli", "switch_lady", "switch_other")


def nodes(objects: DataFrame, key: str, body: str) -> DataFrame:
    """(key, parent, path, depth, name, kind, text): a row for each value inside the JSON of body, itself at path $.

    kind is object, array, string or other; text the value of a string and the JSON of anything else; name the field's name,
    null in an array. A body that is no JSON has no rows. Each level is written, so the plan does not grow with the depth, and
    read by the splits of its files.
    """
    root = objects.select(key, F.lit(None).cast("string").alias("parent"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("name"), F.try_parse_json(F.col(body)).alias("v")).where("v is not null")
    return variants_of(root, key).withColumn("text", F.when(F.col("kind") == "string", F.try_variant_get("v", "$", "string")).otherwise(F.to_json("v"))).drop("v")


def variants_of(root: DataFrame, key: str) -> DataFrame:
    """What nodes says, with v, the value itself, in place of text: it is written as it is and never parsed again."""
    out, depth = None, 0
    level = root
    while True:
        shape = F.schema_of_variant("v")
        kind = F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").when(shape == "STRING", "string").otherwise("other")
        here = written(level.select(key, "parent", "path", F.lit(depth).alias("depth"), "name", kind.alias("kind"), "v"), "json-level")
        out = here if out is None else out.unionByName(here)
        inner = here.where("kind in ('object', 'array')")
        if inner.isEmpty():
            return out
        inner = inner.select(key, F.col("path").alias("parent"), F.col("v").alias("_v"))
        each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNotNull() & (F.col("key") != ""), F.concat(F.lit("."), F.col("key"))) if key != "key" else None
        place = F.concat("parent", F.coalesce(step, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        level, depth = each.select(F.col(key), "parent", place.alias("path"), F.col("key").alias("name"), F.col("value").alias("v")), depth + 1


def strings_with(found: DataFrame, prefix: str, without: tuple[str, ...] = ()) -> DataFrame:
    """found (nodes) of strings that begin with prefix, lower case, but those named in without."""
    low = F.lower("text")
    return found.where((F.col("kind") == "string") & F.startswith(low, F.lit(prefix)) & ~low.isin(*without)).withColumn("text", low)


def declared(found: DataFrame, key: str, name: str) -> DataFrame:
    """(key, declared, text): objects at any depth that have a field name with a non-empty string, by that string with small
    letters and digits alone. Of several of one name the one that comes last by place stands."""
    # An object tells by itself what it declares, so objects and their fields are not joined.
    quote = '"' if "'" in name else "'"
    place = f"$[{quote}{name}{quote}]"
    own = found.where("kind = 'object'").withColumn("_v", F.try_parse_json("text")).withColumn("_name", F.try_variant_get("_v", place, "variant"))
    said = F.try_variant_get("_name", "$", "string")
    own = own.where((F.schema_of_variant("_name") == "STRING") & (said != ""))
    held = own.select(key, "path", "text", F.regexp_replace(F.lower(said), "[^a-z0-9]+", "").alias("declared"))
    return held.groupBy(key, "declared").agg(F.max_by("text", "path").alias("text"))


def field(text: Column, name: str, kind: str = "string") -> Column:
    """A field of an object's JSON, null where it is none or of another kind."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{name}", kind)
