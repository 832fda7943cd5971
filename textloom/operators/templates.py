"""Texts with tokens: references to other texts, filled in language by language, and plurals.

A token is $[Kn|anything]: a letter for the kind of thing and its number. References may hold tokens themselves. They are
filled in from those that hold none, round by round; what is left when a round fills none is on a cycle, or leads to one, and
its tokens into the cycle stay as they are, as do tokens without a reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

# The grammar of tokens and plurals.
TOKEN = r"\$\[([^\]]+)\]"
PLURAL = r"\{PLURAL#([^|{}]+)\|([^|{}]*)\|([^{}]*)\}"


def reference(token: Column) -> Column:
    """(kind, ref) of what stands inside a token: its first letter, and the first number after it."""
    spec = F.trim(F.substring_index(token, "|", 1))
    digits = F.regexp_extract(F.substring(spec, 2, 1_000), "-?[0-9]+", 0)
    return F.struct(F.substring(spec, 1, 1).alias("kind"), F.try_to_number(F.nullif(digits, F.lit("")), F.lit("S999999999999999999")).cast("long").alias("ref"))


def plurals(c: Column) -> Column:
    """{PLURAL#n|one|more} by the number n; one that is no number stays."""
    tokens, between = F.regexp_extract_all(c, F.lit(PLURAL), F.lit(0)), F.split(c, PLURAL, -1)

    def said(token: Column) -> Column:
        count = F.try_to_number(F.trim(F.regexp_extract(token, PLURAL, 1)), F.lit("S999999999.999999")).cast("double")
        return F.when(count.isNull(), token).when(F.abs(count) == 1, F.regexp_extract(token, PLURAL, 2)).otherwise(F.regexp_extract(token, PLURAL, 3))

    return F.array_join(F.zip_with(between, F.transform(tokens, said), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def _tokens(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lang, nth, _kind, _ref): the tokens of rows (keys, lang, content)."""
    each = rows.where(F.contains("content", F.lit("$["))).select(*keys, "lang", F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(1))).alias("nth", "token"))
    return each.select(*keys, "lang", "nth", reference(F.col("token")).alias("r")).select(*keys, "lang", "nth", F.col("r.kind").alias("_kind"), F.col("r.ref").alias("_ref"))


def filled(rows: DataFrame, keys: list[str], refs: DataFrame) -> DataFrame:
    """rows (keys, lang, content) with the tokens filled in that refs (kind, ref, lang, value) has; others stay."""
    named = refs.select(F.col("kind").alias("_kind"), F.col("ref").alias("_ref"), "lang", "value")
    found = _tokens(rows, keys).join(named, ["_kind", "_ref", "lang"]).groupBy(*keys, "lang").agg(F.map_from_entries(F.collect_list(F.struct("nth", "value"))).alias("_said"))
    joined = rows.join(found, [*keys, "lang"], "left")
    tokens, between = F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0)), F.split("content", TOKEN, -1)
    said = F.transform(tokens, lambda t, i: F.coalesce(F.try_element_at("_said", i), t))
    text = F.array_join(F.zip_with(between, said, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return joined.select(*keys, "lang", F.when(F.col("_said").isNull(), F.col("content")).otherwise(text).alias("content"))


def settled(refs: DataFrame) -> DataFrame:
    """refs (kind, ref, lang, value) with their own tokens filled in, as far as no cycle stands in the way."""
    keys = ["kind", "ref"]
    as_rows = lambda d: d.select(*keys, "lang", F.col("value").alias("content"))
    as_refs = lambda d: d.select(*keys, "lang", F.col("content").alias("value"))
    own = written(refs.where("value is not null").groupBy(*keys, "lang").agg(F.min("value").alias("value")), "template-refs")
    done, left = None, own
    while True:
        # Tokens of what is left that lead to something that is left too.
        other = left.select(F.col("kind").alias("_kind"), F.col("ref").alias("_ref"), "lang")
        waits = _tokens(as_rows(left), keys).join(other, ["_kind", "_ref", "lang"], "left_semi").select(*keys, "lang").distinct()
        ready = left.join(waits, [*keys, "lang"], "left_anti")
        if ready.isEmpty():
            rest = left if done is None else as_refs(filled(as_rows(left), keys, done))
            return rest if done is None else done.unionByName(rest)
        ready = ready if done is None else as_refs(filled(as_rows(ready), keys, done))
        done, left = written(ready if done is None else done.unionByName(ready), "template-done"), written(left.join(waits, [*keys, "lang"], "left_semi"), "template-left")


def resolved(texts: DataFrame, keys: list[str], refs: DataFrame) -> DataFrame:
    """(keys, lang, content, changed) of texts (keys, lang, content): tokens and plurals filled in, and whether that
    changed the text."""
    before = texts.select(*keys, "lang", "content")
    after = filled(before, keys, settled(refs)).withColumn("content", plurals(F.col("content")))
    was = before.select(*keys, "lang", F.col("content").alias("_was"))
    return after.join(was, [*keys, "lang"]).select(*keys, "lang", "content", (~F.col("content").eqNullSafe(F.col("_was"))).alias("changed"))


def synthetic(texts: DataFrame, keys: list[str], refs: DataFrame) -> DataFrame:
    """The resolved texts of those keys alone of which at least one language changed: what is worth storing beside the raw."""
    every = resolved(texts, keys, refs)
    worth = every.where("changed").select(*keys).distinct()
    return every.join(worth, keys, "left_semi")
