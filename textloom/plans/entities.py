"""Queries over things and their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities
from ..sources.catalog import Catalog
from .queries import query

# Lines link parts to texts: a kind of thing, a field and a form in one number, a title that may be missing.
LINKS = (
    "links AS (SELECT DISTINCT (l_linenumber % 3 + 1)::INT AS source, l_suppkey AS entity, l_partkey AS hash, l_orderkey % 700 AS title_hash, (l_quantity::INT % 9 + (l_linenumber % 3) * 256)::INT AS extra, (l_suppkey % 4)::INT AS category FROM lineitem), "
    "texts AS (SELECT doc_id AS hash, lang, CASE WHEN n_chars % 11 = 0 THEN '' ELSE text END AS content FROM documents), "
    "best AS (SELECT hash, content, lang FROM texts WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang, content) = 1), "
    "labels(source, category, field, label) AS (VALUES (NULL, NULL, 1, 'description'), (NULL, NULL, 2, 'effect'), (NULL, NULL, 5, 'title'), (2, NULL, 1, 'introduction'), (3, 1, 1, 'skill'), (3, 1, 5, 'name of skill'))"
)


def _tables(c: Catalog) -> tuple[DataFrame, DataFrame, DataFrame]:
    extra = F.col("l_quantity").cast("int") % 9 + (F.col("l_linenumber") % 3) * 256
    links = c.table("lineitem").select(
        (F.col("l_linenumber") % 3 + 1).cast("int").alias("source"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("hash"), (F.col("l_orderkey") % 700).alias("title_hash"), extra.cast("int").alias("extra"), (F.col("l_suppkey") % 4).cast("int").alias("category")
    ).distinct()
    texts = c.table("documents").select(F.col("doc_id").alias("hash"), "lang", F.when(F.col("n_chars") % 11 == 0, "").otherwise(F.col("text")).alias("content"))
    rows = [(None, None, 1, "description"), (None, None, 2, "effect"), (None, None, 5, "title"), (2, None, 1, "introduction"), (3, 1, 1, "skill"), (3, 1, 5, "name of skill")]
    return links, texts, c.spark.createDataFrame(rows, "source int, category int, field int, label string")


@query(
    f"WITH {LINKS}, e AS (SELECT l.source, l.entity, l.hash, t.content AS title, l.extra % 256 AS field, l.extra // 256 AS form, category, b.lang, b.content FROM links l JOIN best b ON b.hash = l.hash LEFT JOIN best t ON t.hash = l.title_hash) "
    "SELECT e.source, e.entity, e.hash, md5(e.title) AS title, coalesce((SELECT min(label) FROM labels x WHERE x.source = e.source AND x.category = e.category AND x.field = e.field), (SELECT min(label) FROM labels x WHERE x.source = e.source AND x.category IS NULL AND x.field = e.field), "
    "(SELECT min(label) FROM labels x WHERE x.source IS NULL AND x.field = e.field), 'text') AS label, e.form::INT AS form, e.lang, length(e.content)::INT AS n_chars FROM e"
)
def entity_entries(c: Catalog) -> DataFrame:
    """What each thing says, with the name of each field and the title in the first language that has it."""
    links, texts, labels = _tables(c)
    rows = entities.entries(links, texts, labels, ["fr", "en"], title_as=F.md5, content_as=F.length)
    return rows.withColumnRenamed("content", "n_chars")


@query(
    f"WITH {LINKS}, f AS (SELECT source, entity, title_hash FROM links QUALIFY row_number() OVER (PARTITION BY source, entity ORDER BY extra, hash, title_hash) = 1), "
    "n AS (SELECT source, entity, count(*) AS n FROM links WHERE hash IN (SELECT hash FROM best) GROUP BY ALL), o AS (SELECT 1 AS source, s_suppkey AS entity FROM supplier WHERE s_acctbal > 5000) "
    "SELECT f.source, f.entity, coalesce(md5(b.content), f.entity::VARCHAR) AS title, coalesce(n, 0) AS n_entries, coalesce(n, 0) = 0 AND o.entity IS NULL AS missing_body "
    "FROM f LEFT JOIN n ON n.source = f.source AND n.entity = f.entity LEFT JOIN best b ON b.hash = f.title_hash LEFT JOIN o ON o.source = f.source AND o.entity = f.entity"
)
def entity_details(c: Catalog) -> DataFrame:
    """A row for each thing: its title or else its number, how many texts it has, and whether it has none anywhere."""
    links, texts, _ = _tables(c)
    bodies = c.table("supplier").where("s_acctbal > 5000").select(F.lit(1).alias("source"), F.col("s_suppkey").alias("entity"))
    rows = entities.details(links, texts, ["fr", "en"], bodies)
    number = F.col("entity").cast("string")
    return rows.select("source", "entity", F.when(F.col("title") == number, number).otherwise(F.md5("title")).alias("title"), "n_entries", "missing_body")


@query(f"WITH {LINKS}, s AS (SELECT DISTINCT hash, source, entity FROM links WHERE NOT (source = 2 AND entity IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5))) SELECT hash, source, entity, count(*) OVER (PARTITION BY hash) AS n_sources, row_number() OVER (PARTITION BY hash ORDER BY source, entity) = 1 AS first FROM s")
def entity_sources(c: Catalog) -> DataFrame:
    """The things that a text belongs to, without hidden ones, and which of them is named first."""
    hidden = c.table("supplier").where("s_nationkey < 5").select(F.lit(2).alias("source"), F.col("s_suppkey").alias("entity"))
    return entities.sources_of(_tables(c)[0], hidden)
