"""What a cut of the lineage leaves on disk."""
import time

from pyspark.sql import functions as F

from newsgauge.session import DROP_SHUFFLES, cut_point


def shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_a_cut_leaves_its_rows_and_no_shuffle_files(spark):
    asked, before = spark.conf.get(DROP_SHUFFLES, None), shuffle_files(spark)
    rows = spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    cut = cut_point(rows.join(rows.withColumnRenamed("n", "m").hint("merge"), "k"), "cut")
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert sorted(map(tuple, cut.collect())) == [(k, n, n) for k, n in zip(range(7), (143,) * 6 + (142,), strict=True)]
    assert spark.conf.get(DROP_SHUFFLES, None) == asked
