"""Paths of sources: what language, kind and thing a path stands for, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of things in file names, and the codes of their kinds.
NAMED = (("Weapon", 9), ("Wings", 19), ("Costume", 5), ("Relic", 10))


def normal(path: Column) -> Column:
    """Forward slashes, none at the ends; null is empty."""
    return F.btrim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/"))


def under(path: Column, folder: str) -> Column:
    """(lang, rest) of a path whose first part, but for the folder, is a language; null where a part is missing."""
    parts = rf"(?s)^(?:{folder}/)?+([^/]*)/(.*)$"
    lang, rest = F.regexp_extract(normal(path), parts, 1), F.btrim(F.regexp_extract(normal(path), parts, 2), F.lit("/"))
    return F.when((lang != "") & (rest != ""), F.struct(lang.alias("lang"), rest.alias("rest")))


def built(folder: str, lang: Column, name: Column, suffix: str = "") -> Column:
    """The path of a name in a language; null where one is empty. A suffix that the name has already is not doubled."""
    lang, name = normal(lang), normal(name)
    if suffix:
        name = F.when(F.endswith(F.lower(name), F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)
    return F.when((lang != "") & (name != ""), F.concat(F.lit(f"{folder}/"), lang, F.lit("/"), name, F.lit(suffix)))


def subtitle_file(path: Column) -> Column:
    """(lang, rest) of a subtitle file without its ending; null for other files."""
    parts = r"(?s)^(?:Subtitle/)?+([^/]+)/+(.*[^/])/*(?i:\.srt)$"
    lang, stem = F.regexp_extract(normal(path), parts, 1), F.regexp_extract(normal(path), parts, 2)
    return F.when(lang != "", F.struct(lang.alias("lang"), stem.alias("rest")))


def key_parts(key: Column) -> Column:
    """(name, lang_id) of a subtitle's key: four parts with bars, or at least four with underscores, the last three not the
    name's; null otherwise."""
    bars, lines = F.split(key, r"\|"), F.split(key, "_")
    number = lambda c: F.try_to_number(F.nullif(F.trim(c), F.lit("")), F.lit("S999999999")).cast("int")
    name = F.when(F.contains(key, F.lit("|")), F.when(F.size(bars) == 4, F.get(bars, F.lit(0)))).when(F.size(lines) >= 4, F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 3, F.lit(0))), "_"))
    lang = F.when(F.contains(key, F.lit("|")), number(F.get(bars, F.lit(1)))).otherwise(number(F.get(lines, F.size(lines) - 3)))
    return F.when((name != "") & lang.isNotNull(), F.struct(name.alias("name"), lang.alias("lang_id")))


def thing(path: Column) -> Column:
    """(kind, id, piece) of a file that is named after a thing; null for others. Skins and pieces of sets are looked up by
    these numbers."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(normal(path), "([^/]*)$", 1), r"\.[^.]*$", ""), "_[A-Z]{2,3}$", "")
    number = lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("999999999999")).cast("long")
    out = F.lit(None)
    for name, kind in NAMED:
        pattern = rf"(?i)^{name}(\d+)" + (r"(?:_(\d+))?$" if name == "Relic" else "()$")
        own = F.struct(F.lit(kind).alias("kind"), number(F.regexp_extract(stem, pattern, 1)).alias("id"), number(F.regexp_extract(stem, pattern, 2)).alias("piece"))
        out = F.when(F.regexp_like(stem, F.lit(pattern)), own).otherwise(out)
    return out


def name_variants(path: Column) -> Column:
    """The names that a file is looked up by: with and without its ending, each with and without a language's suffix."""
    base = F.regexp_extract(normal(path), "([^/]*)$", 1)
    root, ending = F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1)
    bare = F.regexp_replace(root, "_[A-Z]{2,3}$", "")
    return F.array_distinct(F.filter(F.array(base, root, F.concat(bare, ending), bare), lambda x: x != ""))
