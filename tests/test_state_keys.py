"""State kept for many items and seats under few keys, and rows without an id."""
import datetime as dt

from pyspark.sql import functions as F

from lectern.plans.queries_streams import STATE, UTC, settings
from lectern.session import scratch_path
from lectern.streaming import stateful

START = dt.datetime(2024, 3, 1)
CHANGES = "event_id bigint, ts timestamp_ntz, kind string, guard string"
ACTIVITY = "event_id bigint, ts timestamp_ntz, seat string, units int"


def stream(spark, *batches):
    """Tables as a file stream, each a micro-batch of its own."""
    path = scratch_path(spark, "stream")
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, frame):
    """The rows of each micro-batch, and the rows of state after it."""
    batches = []
    with settings(spark, **UTC, **STATE):
        query = frame.writeStream.foreachBatch(lambda batch, n: batches.append([tuple(r) for r in batch.collect()])).option(
            "checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return batches, [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_items_share_keys(spark):
    first = spark.range(30_000).select(F.col("id").alias("event_id"), F.lit(START).cast("timestamp_ntz").alias("ts"), F.lit("store").alias("kind"), F.lit(None).cast("string").alias("guard"))
    later = spark.createDataFrame([(i, START + dt.timedelta(hours=3), "store", None) for i in (7, 40_000)], CHANGES)
    batches, held = run(spark, stateful.expire_stream(stream(spark, first, later)))
    assert sorted(r[0] for b in batches for r in b) == [i for i in range(30_000) if i != 7]
    assert max(held) <= 4 * stateful.ITEM_PARTS       # a value, a timer and its index for each key, not for each item


def test_seats_share_keys(spark):
    asked = spark.range(12_000).select("id", F.lit(START).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("s"), (F.col("id") / 3).cast("int")).alias("seat"), F.lit(6000).alias("units"))
    end = spark.createDataFrame([(90_000, START + dt.timedelta(hours=3), "end", 1)], ACTIVITY)
    batches, held = run(spark, stateful.admit_stream(stream(spark, asked.toDF("event_id", "ts", "seat", "units"), end)))
    got = {r[0]: (r[1], r[2], r[3]) for b in batches for r in b}
    assert got == {i: (f"s{i // 3}", "2024-03-01", i % 3 < 2) for i in range(12_000)}
    assert max(held) <= 8 * stateful.SEAT_PARTS


def test_ids_beside_null_ones_are_kept_exactly(spark):
    """A null beside them made ids doubles."""
    big, end = 2**60 + 1, START + dt.timedelta(hours=3)
    stored = [(None, START, "store", None), (big, START, "store", None), (5, START, "store", None), (6, None, "store", None), (7, START, None, None), (big, START, "protect", None)]
    changes = spark.createDataFrame(stored, CHANGES), spark.createDataFrame([(9, end, "release", None)] * 2, CHANGES)
    batches, _ = run(spark, stateful.expire_stream(stream(spark, *changes)))
    assert sorted((r[0] for b in batches for r in b), key=str) == [5, None]
    asked = [(None, START, "a", 20_000), (big, START, "a", None), (5, START, "b", 2**31 - 1), (6, START, "b", 1), (7, None, "b", 1), (8, START, None, 1)]
    requests = spark.createDataFrame(asked, ACTIVITY), spark.createDataFrame([(9, end, "c", 1)], ACTIVITY)
    got, _ = run(spark, stateful.admit_stream(stream(spark, *requests)))
    assert sorted((r[1], str(r[0]), r[3]) for b in got for r in b) == [("a", str(big), True), ("a", "None", True), ("b", "5", True), ("b", "6", False)]
