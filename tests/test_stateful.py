"""Admission in order and expiry on streams, over several micro-batches and Arrow batches."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.plans.queries_streams import STATE, UTC, settings
from lectern.session import scratch_path
from lectern.streaming import activity as ac
from lectern.streaming import jobs, stateful

START = dt.datetime(2024, 3, 1)
ACTIVITY = "event_id bigint, ts timestamp_ntz, seat string, units int"


def stream(spark, rows, schema, files):
    """Rows as a file stream, one file a micro-batch, in the order given."""
    path = scratch_path(spark, "stream")
    each = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * each:(i + 1) * each], schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path))


@pytest.mark.parametrize("units", [1, 150])
def test_one_busy_seat_is_admitted_in_order(spark, units):
    rng = random.Random(units)
    rows = [(i, START + dt.timedelta(seconds=4 * i + rng.randrange(3)), "hot", rng.randrange(-1, 2 * units)) for i in range(20_000)]
    rows += [(50_000 + i, START + dt.timedelta(seconds=rng.randrange(80_000)), f"s{i % 7}", None if i % 9 == 0 else units) for i in range(900)]
    rows += [(60_000, START + dt.timedelta(hours=1), None, 5)]
    late_by = {r[0]: r[1] + dt.timedelta(seconds=rng.randrange(500)) for r in rows}
    rows.sort(key=lambda r: late_by[r[0]])                      # out of order, within the watermark
    end = [(90_000, START + dt.timedelta(days=2), "end", 1)] * 3
    with settings(spark, **UTC, **STATE, spark__sql__execution__arrow__maxRecordsPerBatch="700"):
        got = jobs.run_to_table(stateful.admit_stream(stream(spark, rows + end, ACTIVITY, 5)), "admit").collect()
    want = jobs.usage_admission(spark.createDataFrame(rows, ACTIVITY)).collect()
    assert sorted((r.event_id, r.seat, r.day, r.admitted) for r in got) == sorted((r.event_id, r.seat, str(r.day), r.admitted) for r in want)
    assert sum(r.admitted for r in got if r.seat == "hot") in range(50, 101)


def test_expiry_tells_each_item_once_and_forgets_it(spark):
    def at(minutes):
        return START + dt.timedelta(minutes=minutes)
    changes = "event_id bigint, ts timestamp_ntz, kind string, guard string"
    rows = [(1, at(0), "store", None), (2, at(0), "store", None), (2, at(1), "protect", "a"), (2, at(1), "protect", "b"),
            (3, at(2), "store", None), (4, at(0), "store", None),
            (4, at(55), "store", None), (3, at(56), "protect", "a"), (3, at(57), "release", "a"), (5, at(58), "release", "never held"),
            (9, at(75), "release", None), (9, at(76), "release", None), (9, at(77), "release", None), (9, at(78), "release", None), (9, at(79), "release", None),
            (2, at(80), "release", "a"), (9, at(300), "release", None), (9, at(300), "release", None), (9, at(300), "release", None), (9, at(300), "release", None),
            (2, at(301), "release", "b"), (9, at(301), "release", None), (9, at(301), "release", None), (9, at(302), "release", None), (9, at(302), "release", None),
            (9, at(600), "release", None)]
    batches, left = [], []

    def keep(batch, n):
        batches.append(sorted(r.event_id for r in batch.collect()))

    with settings(spark, **UTC, **STATE):
        query = stateful.expire_stream(stream(spark, rows, changes, 6)).writeStream.foreachBatch(keep).option(
            "checkpointLocation", scratch_path(spark, "expiry")).trigger(availableNow=True).start()
        query.awaitTermination()
        left = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    told = [b for b in batches if b]
    assert sorted(sum(told, [])) == [1, 2, 3, 4]
    assert told[0] == [1, 3] and told[1] == [4] and told[-1] == [2]
    assert max(left) > 0 and left[-1] == 0


def test_late_rows_of_two_streams_at_once(spark):
    """Each call counts its own drops, though both report to the same session."""
    from concurrent.futures import ThreadPoolExecutor

    def events(late):
        rows = [(i, START + dt.timedelta(days=5, minutes=i)) for i in range(40)] + [(100 + i, START + dt.timedelta(days=5, hours=3)) for i in range(40)]
        rows += [(200 + i, START + dt.timedelta(minutes=i)) for i in range(late)] + [(300 + i, START + dt.timedelta(days=6)) for i in range(40 - late)]
        return stream(spark, rows, "event_id bigint, ts timestamp_ntz", 3)

    with settings(spark, **UTC), ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda n: jobs.late_rows(events(n), f"late{n}")[1], [7, 30]))
    assert found == [7, 30]


@pytest.mark.parametrize("files", [1, 3])
def test_tables_of_one_or_several_files_are_streamed(spark, files):
    """A table is one file of its name, or a folder of that name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = scratch_path(spark, "tables")
    rows = spark.createDataFrame([("user", f"words {i % 4}") for i in range(12)], "source string, text string")
    if files > 1:
        rows.repartition(files).write.parquet(f"{path}/said.parquet")
    else:
        os.makedirs(path)
        pq.write_table(pa.table({"source": ["user"] * 12, "text": [f"words {i % 4}" for i in range(12)]}), f"{path}/said.parquet")
    rows.limit(1).withColumn("text", F.lit("other")).write.parquet(f"{path}/said.parquet.old")
    got = jobs.ingest_stream(ac.read_events(spark, path, "said.parquet")).collect()
    assert sorted(r["text"] for r in got) == [f"words {i}" for i in range(4)]
