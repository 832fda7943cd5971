"""Readers of the corpus' source files, all by Spark's own readers so that any store will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seconds(stamp: Column) -> Column:
    """HH:MM:SS,mmm in seconds; anything else is 0."""
    parts = F.split(F.replace(F.trim(stamp), F.lit(","), F.lit(".")), ":")
    at = lambda i: F.try_to_number(F.get(parts, F.lit(i)), F.lit("999999.999999")).cast("double")
    return F.coalesce(F.when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2)), F.lit(0.0))


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, start_time, end_time, content, subtitle_key) of SRT files under path; blocks without an arrow are left out."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    blocks = files.select("file_name", F.explode(F.split("value", r"\n[ \t]*\n+")).alias("block")).withColumn("lines", F.split(F.btrim("block", F.lit(" \n\t")), "\n"))
    arrow = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)
    blocks = blocks.withColumn("at", arrow.cast("int")).where("at > 0").withColumn("times", F.split(F.element_at("lines", F.col("at")), "-->"))
    rows = blocks.select(
        "file_name",
        seconds(F.col("times")[0]).alias("start_time"),
        seconds(F.col("times")[1]).alias("end_time"),
        F.trim(F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0))), "\n")).alias("content"),
    )
    return rows.withColumn("subtitle_key", F.format_string("%s|%.3f|%.3f", "file_name", "start_time", "end_time"))


def text_maps(spark: SparkSession, path: str) -> DataFrame:
    """(base, hash, content) of JSON objects from hash to text; of a base's files the last in order wins each hash."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.from_json("value", "map<string,string>").alias("pairs"))
    found = r"^Text(?:Map)?(_Medium)?([A-Z]+)(?:_(\d+))?\.json$"
    part = F.try_to_number(F.regexp_extract("name", found, 3), F.lit("999999"))
    files = files.where(F.col("name").rlike(found) & F.col("pairs").isNotNull()).select(
        F.regexp_extract("name", found, 2).alias("base"), (F.regexp_extract("name", found, 1) != "").cast("int").alias("variant"), F.coalesce(part, F.lit(-1)).alias("part"), "name", F.explode("pairs").alias("hash", "content")
    )
    rows = files.withColumn("hash", F.expr("try_cast(hash AS long)")).where("hash is not null")
    last = Window.partitionBy("base", "hash").orderBy(F.desc("variant"), F.desc("part"), F.desc("name"))
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").select("base", "hash", "content")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each; what does not parse is left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content) of plain text files, line ends as a written \\n."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("value", "\r\n|\r|\n", r"\\\\n").alias("content"))


def first_value(*names: str) -> Column:
    """The first of several alias columns that is not null."""
    return F.coalesce(*map(F.col, names))


def first_nonzero(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(n), F.lit(0)) for n in names))
