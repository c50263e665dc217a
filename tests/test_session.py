"""Written tables and the shuffles that made them, and shares of a scan."""
import glob
import time

from pyspark.sql import functions as F

from lectern.session import materialize, settings, spread


def test_shuffles_go_with_the_write(spark):
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    before, time_left = files(), 50
    held = materialize(spark.range(200_000).groupBy((F.col("id") % 100_003).alias("k")).count(), "counted")
    while files() - before and time_left:                 # executors delete them on their own time
        time_left -= 1
        time.sleep(0.1)
    assert not files() - before
    assert held.count() == 100_003


def test_splits_are_dealt_into_bounded_shares(spark, tmp_path):
    path, share = str(tmp_path / "texts"), 16 << 10
    spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "texts").glob("*.parquet"))
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(512 << 10)}):
        scan = spark.read.parquet(path)
        dealt = spread(scan, share)
        assert dealt.rdd.getNumPartitions() * share >= size
        assert dealt.count() == 60_000 and spread(dealt).rdd.getNumPartitions() == dealt.rdd.getNumPartitions()
