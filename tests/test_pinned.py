import time

from pyspark.sql import functions as F

from lakemoor.session import pinned


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if "shuffle" in str(blocks.apply(i))}


def test_shuffle_files_of_a_pinned_table_go(spark):
    """Otherwise the disk holds those of all steps until the driver collects its garbage."""
    before = shuffle_files(spark)
    counts = spark.range(200_000).groupBy((F.col("id") % 1000).alias("k")).count()
    kept = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    found = pinned(counts.join(counts.withColumnRenamed("count", "again"), "k"))
    for _ in range(50):  # they are removed in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert found.filter("count = 200 AND again = 200").count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == kept
