"""Logical tables of the engine over the supplied ones, and the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import versions

TEXT_MAP = (
    "text_map AS (SELECT doc_id AS hash, lang, text AS content, doc_id % 12 + 1 AS created_version_id, doc_id % 12 + 1 + n_chars % 3 AS updated_version_id FROM documents)"
)
VERSION_DIM = (
    "version_dim AS (SELECT id, 'Version ' || (1 + id // 6) || '.' || (id % 6) || '.0' AS raw_version, (1 + id // 6) || '.' || (id % 6) AS version_tag, "
    "(1 + id // 6) * 1000 + id % 6 AS version_sort_key FROM (SELECT unnest(range(1, 15)) AS id))"
)
DIALOGUE = "dialogue AS (SELECT conv_id * 1000 + turn AS dialogue_id, conv_id AS talk_id, turn, role AS talker_type, text FROM conversations)"
VOICED = "voiced AS (SELECT doc_id AS hash FROM labels WHERE quality = 1 UNION SELECT item_id AS hash FROM benchmark)"


class Catalog:
    """Readers of one folder of parquet tables; nothing is read before a query needs it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def text_map(self) -> DataFrame:
        created = F.col("doc_id") % 12 + 1
        return self.table("documents").select(
            F.col("doc_id").alias("hash"), "lang", F.col("text").alias("content"), created.alias("created_version_id"), (created + F.col("n_chars") % 3).alias("updated_version_id")
        )

    def version_dim(self) -> DataFrame:
        ids = self.spark.range(1, 15)
        tag = F.concat_ws(".", F.expr("1 + id div 6").cast("string"), (F.col("id") % 6).cast("string"))
        ids = ids.select("id", F.concat(F.lit("Version "), tag, F.lit(".0")).alias("raw_version"))
        tagged = ids.withColumn("version_tag", versions.tag(F.col("raw_version")))
        return tagged.withColumn("version_sort_key", versions.sort_key(F.col("version_tag")))

    def dialogue(self) -> DataFrame:
        return self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("dialogue_id"), F.col("conv_id").alias("talk_id"), "turn", F.col("role").alias("talker_type"), "text")

    def voiced(self) -> DataFrame:
        spoken = self.table("labels").where("quality = 1").select(F.col("doc_id").alias("hash"))
        return spoken.union(self.table("benchmark").select(F.col("item_id").alias("hash"))).distinct()
