"""Range-split ranking against plain windows, on a key that holds most rows."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 400)
    return spark.createDataFrame([(i, None if n % 19 == 0 else "hot" if n % 3 else f"k{n % 5}", n % 11) for n, i in enumerate(ids)],
                                 "idx bigint, key string, x int")


def as_set(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("desc", [False, True])
def test_row_number(skewed, desc):
    w = Window.partitionBy("key").orderBy(F.desc("idx") if desc else F.asc("idx"))
    want = skewed.withColumn("rn", F.row_number().over(w))
    assert as_set(ranking.row_number(skewed, ["key"], "idx", "rn", desc), "idx", "rn") == as_set(want, "idx", "rn")


def test_global_row_number(skewed):
    want = skewed.withColumn("rn", F.row_number().over(Window.orderBy("idx")))
    assert as_set(ranking.row_number(skewed, [], "idx", "rn"), "idx", "rn") == as_set(want, "idx", "rn")


def test_running_and_neighbours(skewed):
    w = Window.partitionBy("key").orderBy("idx")
    want = skewed.withColumn("s", F.coalesce(F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert as_set(ranking.running_before(skewed, ["key"], "idx", "idx", {"s": "x"}), "idx", "s") == as_set(want, "idx", "s")
    want = skewed.withColumn("p", F.lag("idx").over(w)).withColumn("n", F.lead("idx").over(w))
    assert as_set(ranking.neighbours(skewed, ["key"], "idx", "p", "n"), "idx", "p", "n") == as_set(want, "idx", "p", "n")


def test_top_per_key(skewed):
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("x"), "idx"))).filter("rank <= 7")
    got = ranking.top_per_key(skewed, ["key"], 7, [F.desc("x"), F.asc("idx")], "idx")
    assert as_set(got, "idx", "rank") == as_set(want, "idx", "rank")


def test_ranges_are_even_on_clustered_values(spark):
    rows = spark.range(9500).selectExpr("id AS idx").unionAll(spark.range(500).selectExpr("id + 10000000000 AS idx"))
    sizes = [r["count"] for r in ranking.with_range(rows, "idx").groupBy("_range").count().collect()]
    assert max(sizes) <= 0.02 * 10_000
    got = ranking.row_number(rows, [], "idx", "rn").collect()
    assert [r["rn"] for r in sorted(got, key=lambda r: r["idx"])] == list(range(1, 10_001))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_in_order(spark, skewed, ranges):
    rows = skewed.withColumn("many", F.when(F.col("idx") % 7 > 0, F.col("x") * 3)).union(
        spark.createDataFrame([(20_000 + i, "hot", i % 3, i) for i in range(500)], "idx bigint, key string, x int, many int"))
    got = ranking.in_order(rows, ["key"], [F.col("x"), F.desc("idx")], "rn", {"upto": "many"}, {"mixed": "idx"}, ranges)
    w = Window.partitionBy("key").orderBy("x", F.desc("idx"))
    want = rows.withColumn("rn", F.row_number().over(w)).withColumn("upto", F.coalesce(F.sum("many").over(w.rowsBetween(
        Window.unboundedPreceding, 0)), F.lit(0))).withColumn("mixed", F.bit_xor("idx").over(w))
    assert as_set(got, *want.columns) == as_set(want, *want.columns)


def test_in_order_without_keys_or_rows(skewed):
    w = Window.orderBy("idx")
    assert as_set(ranking.in_order(skewed, [], [F.col("idx")], "rn", ranges=5), "idx", "rn") == as_set(
        skewed.withColumn("rn", F.row_number().over(w)), "idx", "rn")
    assert ranking.in_order(skewed.limit(0), ["key"], [F.col("idx")], "rn").collect() == []
