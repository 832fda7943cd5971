"""A training corpus from the documents table, in stages whose decisions take effect on what the next one gets.

1. Quality rules: documents that they reject go.
2. N-gram Jaccard join: of each group of linked documents the one with the smallest doc_id stays (one without a doc_id
   only where all are). Rows are linked by their texts alone: rows of one doc_id with different texts all stay.
3. Benchmark decontamination: documents with a window of a benchmark item go.
4. Personal data: every span found is replaced by its kind in brackets, and n_chars follows.
5. Packing: the pieces of what is left, in sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever they
are named. A null or empty text is rejected by the first stage; later stages take a null as empty. Very long texts are
whole in every stage. Of rows that are linked and tie in doc_id the one with the first text stays. An empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common, decontaminate, jaccard, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows go by numbers of their own, so they are linked by their texts alone, whatever their doc_id.
    rows = docs.select(F.monotonically_increasing_id().alias("_n"), F.col("doc_id").cast("long").alias("_id"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    groups = jaccard.join(rows.select(F.col("_n").alias("doc_id"), "_row.text")).select(F.col("doc_id").alias("_n"), "component_id")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_n")).alias("first")
    stay = groups.join(rows.select("_n", "_id"), "_n").groupBy("component_id").agg(first).select("first._n")
    return rows.join(stay, "_n", "left_semi").select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The verdict depends on the text alone, so rows that share a key of 128 bits share it.
    key = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontaminate.leaked(docs.select(key.alias("key"), "text"), bench, "key").select(F.col("key").alias("_key"))
    rows = docs.select(key.alias("_key"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return rows.join(leaked, "_key", "left_anti").select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = pii.find(docs.select("text", F.struct(*(docs[c] for c in docs.columns)).alias("_row")), mask=True)
    columns = {c: F.col("_row")[c] for c in rest} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]
#: SQL has neither the language model nor the field nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
