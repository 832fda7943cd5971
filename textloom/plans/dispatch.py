"""Queries of the search over all kinds of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dispatch
from ..sources.catalog import TEXT_MAP, VOICED, Catalog
from .queries import query

# Pages and turns of talks have no language of their own here: all count as English.
TABLES = (
    f"{TEXT_MAP}, {VOICED}, sources AS (SELECT DISTINCT doc_id AS hash, CASE WHEN toxic = 1 THEN 'quest' ELSE 'item' END AS source FROM labels), "
    "pages_ AS (SELECT page_id::VARCHAR AS key, html AS content FROM pages), subs AS (SELECT (conv_id * 1000 + turn)::VARCHAR AS key, text AS content FROM conversations)"
)
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql(word: str, lang: str, voice: str | None = None, source: str | None = None, number: int = 1, size: int = 50, hash_: int | None = None) -> str:
    has = f"contains({FOLD.format('content')}, '{word}')"
    norm = FOLD.format("trim(coalesce(content, ''))")
    texts = f"SELECT 'text' AS kind, t.hash::VARCHAR AS key, content, v.hash IS NOT NULL AS has_voice, coalesce(t.hash = {hash_ if hash_ is not None else 'NULL'}, false) AS is_hash FROM text_map t LEFT JOIN voiced v ON v.hash = t.hash WHERE lang = '{lang}' AND ({has}{f' OR t.hash = {hash_}' if hash_ is not None else ''})"
    texts += {None: "", "with": " AND v.hash IS NOT NULL", "without": " AND v.hash IS NULL"}[voice]
    if source == "unknown":
        texts += " AND t.hash NOT IN (SELECT hash FROM sources)"
    elif source not in (None, "textmap"):
        texts += f" AND t.hash IN (SELECT hash FROM sources WHERE source = '{source}')"
    other = [f"SELECT '{kind}', key, content, false, false FROM {table} WHERE {has}" for kind, table in (("readable", "pages_"), ("subtitle", "subs")) if source in (None, kind) and voice != "with" and lang == "en"]
    parts = ([texts] if source not in ("readable", "subtitle") else []) + other
    return (
        f"WITH {TABLES}, h(kind, key, content, has_voice, is_hash) AS ({' UNION ALL '.join(parts)}), "
        f"r AS (SELECT kind, key, (CASE WHEN {norm} = '{word}' THEN 0 WHEN starts_with({norm}, '{word}') THEN 1 WHEN contains({norm}, '{word}') THEN 2 ELSE 3 END)::INT AS tier, has_voice, length({norm})::INT AS length, is_hash, (SELECT count(*) FROM h) AS total FROM h) "
        f"SELECT * FROM r ORDER BY is_hash DESC, tier, has_voice DESC, length, kind, key LIMIT {size} OFFSET {(number - 1) * size}"
    )


def _corpus(c: Catalog) -> dispatch.Corpus:
    kind = F.when(F.col("toxic") == 1, "quest").otherwise("item").alias("source")
    en = F.lit("en").alias("lang")
    return dispatch.Corpus(
        c.text_map().select("hash", "lang", "content"),
        c.voiced(),
        c.table("labels").select(F.col("doc_id").alias("hash"), kind).distinct(),
        c.table("pages").select(F.col("page_id").cast("string").alias("key"), en, F.col("html").alias("content")),
        c.dialogue().select(F.col("dialogue_id").cast("string").alias("key"), en, F.col("text").alias("content")),
    )


@query(_sql("the", "en"))
def search_everything(c: Catalog) -> DataFrame:
    return dispatch.page(_corpus(c), "“The”", "en")


@query(_sql("the", "en", "with", number=2, size=20))
def search_voiced(c: Catalog) -> DataFrame:
    """Only what has a voice: pages and subtitles have none."""
    return dispatch.page(_corpus(c), "the", "en", "with", number=2, size=20)


@query(_sql("and", "en", "without", size=80))
def search_unvoiced(c: Catalog) -> DataFrame:
    return dispatch.page(_corpus(c), "AND", "en", "without", size=80)


@query(_sql("de", "fr", None, "item", size=30))
def search_by_source(c: Catalog) -> DataFrame:
    return dispatch.page(_corpus(c), "de", "fr", source="item", size=30)


@query(_sql("la", "fr", "without", "unknown", size=30))
def search_unknown_unvoiced(c: Catalog) -> DataFrame:
    return dispatch.page(_corpus(c), "la", "fr", "without", "unknown", size=30)


@query(_sql("the", "en", "without", "readable", size=25))
def search_readable(c: Catalog) -> DataFrame:
    return dispatch.page(_corpus(c), "the", "en", "without", "readable", size=25)


@query(_sql("tion", "en", None, "subtitle", size=25))
def search_subtitles(c: Catalog) -> DataFrame:
    return dispatch.page(_corpus(c), "tion", "en", source="subtitle", size=25)


@query(_sql("12", "en", hash_=12, size=25))
def search_hash(c: Catalog) -> DataFrame:
    """A number as keyword: the text of that hash stands first."""
    return dispatch.page(_corpus(c), "12", "en", size=25)
