from pyspark.sql import functions as F

from textloom.operators import scratch


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_written_tables_go(spark):
    """A table between steps leaves no shuffle on disk, and the session's setting is as it was."""
    set_before, before = spark.conf.get(scratch.CLEANUP, None), shuffles(spark)
    rows = spark.range(50_000).withColumn("k", F.col("id") % 999).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert scratch.written(rows, "counts").agg(F.sum("n")).first()[0] == 50_000
    own = shuffles(spark) - before
    assert spark.conf.get(scratch.CLEANUP, None) == set_before
    # The sum above has one shuffle of a single row; the grouping's are gone.
    assert len({name.split("_")[1] for name in own}) <= 1
