"""Streaming jobs: batch admission, ingest, late rows, and running to a table."""
from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import build, filters, ranking
from ..session import scratch_path
from .activity import REQUEST_CAP, UNIT_CAP, WATERMARK


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain the stream into Parquet below the shared folder. Update and complete results are
    written per batch and reduced by the caller."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, label)
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", path)
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        sink = stream.writeStream.foreachBatch(save)
    query = sink.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    read = spark.read.schema(stream.schema)
    return (read.parquet(path) if mode == "append" else spark.read.parquet(path))


# -- admission --------------------------------------------------------------------------------------------

def usage_admission(activity: DataFrame) -> DataFrame:
    """Batch form: a request is admitted iff the day's earlier count and units are under the caps.

    The earlier totals only grow, so counting refused requests too changes no answer.
    """
    day = F.date_trunc("day", "ts").cast("date")
    rows = activity.filter("seat IS NOT NULL").select(
        "event_id", "ts", "seat", day.alias("day"), F.greatest("units", F.lit(0)).alias("units"), F.lit(1).alias("one"))
    before = ranking.running_before(rows, ["seat", "day"], "ts", "event_id", {"prior_requests": "one", "prior_units": "units"})
    admitted = (F.col("prior_requests") < REQUEST_CAP) & (F.col("prior_units") < UNIT_CAP)
    return before.select("event_id", "seat", "day", "prior_requests", "prior_units", admitted.alias("admitted"))


# -- ingest -------------------------------------------------------------------------------------------------

def ingest_stream(documents: DataFrame, label: str = "ingest", size: int = 300, overlap: int = 50) -> DataFrame:
    """Chunk new documents and append each content once.

    Within a batch equal contents collapse; against earlier batches the stored keys are the filter.
    A replayed batch overwrites its own folder, so a restart adds nothing twice.
    """
    spark = documents.sparkSession
    path = scratch_path(spark, label)
    names = "batch bigint, content_key string, source string, text string"

    def store(batch: DataFrame, batch_id: int) -> None:
        parts = build.chunk_documents(batch.select("source", "text"), size, overlap)
        keyed = parts.withColumn("content_key", filters.content_key(F.col("text")))
        once = keyed.groupBy("content_key").agg(F.min_by(F.struct("source", "text"), F.struct("source", "part")).alias("r"))
        fresh = once.select("content_key", "r.source", "r.text")
        if batch_id > 0:
            known = spark.read.schema(names).parquet(path).filter(F.col("batch") < batch_id).select("content_key")
            fresh = fresh.join(known, "content_key", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (documents.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(names).parquet(path).select("content_key", "source", "text")


# -- late rows -------------------------------------------------------------------------------------------------

class _Dropped(StreamingQueryListener):
    """Sums what the operators of each run drop; every progress report counts, however many there are. Reports of other streams
    of the session arrive here as well, so they are kept apart by run."""

    def __init__(self):
        self.rows, self.over, self.news = defaultdict(int), set(), threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        with self.news:
            self.rows[str(event.progress.runId)] += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.news:
            self.over.add(str(event.runId))
            self.news.notify_all()

    def of(self, run: str, seconds: int = 120) -> int:
        """Rows dropped by a run, once its end has been reported."""
        with self.news:
            if not self.news.wait_for(lambda: run in self.over, seconds):
                raise RuntimeError("the end of the stream was not reported")
            return self.rows[run]


def late_rows(events: DataFrame, label: str = "late") -> tuple[DataFrame, int]:
    """Hourly counts of a stream with a 10-minute watermark, and how many events came too late.

    Events are held against the watermark one by one, as they are told from repeats by event_id, and counted
    after that; so the number is of events, not of partial counts.
    """
    spark, path = events.sparkSession, scratch_path(events.sparkSession, label)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
    counts = timed.dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    dropped = _Dropped()
    spark.streams.addListener(dropped)
    try:
        query = (counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
        late = dropped.of(str(query.runId))
    finally:
        spark.streams.removeListener(dropped)
    return spark.read.schema("start string, n bigint").parquet(path), late
