"""Activity over time. Each function takes a stream or a table, so a stream has a batch twin.

``activity`` (event_id, ts, corpus_id, seat, event_type, units, props). Stream time zone is UTC.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters

WATERMARK = "10 minutes"
REQUEST_CAP, UNIT_CAP, WARN_AT = 100, 10_000, 0.8     # fixed values of the daily quota
LEASE = "90 seconds"
TTL_SECONDS = 3600


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 1000) -> DataFrame:
    """File stream over an event table, which may be one file or a folder of files. As a pattern, the path may name either."""
    base = folder.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/{{{name}}}")


def timed(df: DataFrame) -> DataFrame:
    """Event time with its watermark; a stream needs a zoned timestamp."""
    if not df.isStreaming:
        return df
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def activity_feed(activity: DataFrame, since: str, corpus_id: int | None = None, event_type: str | None = None) -> DataFrame:
    """Events since a time; newest first where the input is a table."""
    rows = activity.filter(F.col("ts") >= F.lit(since).cast(activity.schema["ts"].dataType))
    if corpus_id is not None:
        rows = rows.filter(F.col("corpus_id") == corpus_id)
    if event_type is not None:
        rows = rows.filter(F.col("event_type") == event_type)
    return rows if rows.isStreaming else rows.orderBy(F.desc("ts"), F.desc("event_id"))


def _start(window: Column) -> Column:
    return F.date_format(window["start"], "yyyy-MM-dd HH:mm:ss")


def activity_counts(activity: DataFrame, width: str = "1 hour") -> DataFrame:
    counts = timed(activity).groupBy(F.window("ts", width).alias("w"), "corpus_id", "event_type").agg(F.count("*").alias("n"))
    return counts.select(_start(F.col("w")).alias("start"), "corpus_id", "event_type", "n")


def daily_usage(activity: DataFrame) -> DataFrame:
    """Requests and units per seat and UTC day against the caps."""
    used = timed(activity.filter("seat IS NOT NULL")).groupBy(F.window("ts", "1 day").alias("w"), "seat").agg(
        F.count("*").alias("requests"), F.sum(F.greatest("units", F.lit(0))).alias("units"))
    return with_quota(used).select(_start(F.col("w")).alias("day"), "seat", "requests", "units", "used_pct", "over_cap", "warn")


def with_quota(df: DataFrame, requests: str = "requests", units: str = "units") -> DataFrame:
    share = F.greatest(F.col(requests) / REQUEST_CAP, F.col(units) / UNIT_CAP)
    return (df.withColumn("used_pct", F.floor(share * 100).cast("int"))
            .withColumn("over_cap", (F.col(requests) >= REQUEST_CAP) | (F.col(units) >= UNIT_CAP))
            .withColumn("warn", share >= WARN_AT))


def seat_attention(activity: DataFrame, body: Column) -> DataFrame:
    """Touches and last visit per seat and content key; anonymous visits are not tracked."""
    keyed = activity.filter("seat IS NOT NULL").withColumn("content_key", filters.content_key(body))
    return timed(keyed).groupBy("seat", "content_key").agg(F.count("*").alias("touches"), F.max("ts").alias("last_seen"))


def writer_sessions(activity: DataFrame, gap: str = LEASE) -> DataFrame:
    """Runs of renewals at most ``gap`` apart, per corpus and seat."""
    runs = timed(activity.filter("seat IS NOT NULL")).groupBy(F.session_window("ts", gap).alias("w"), "corpus_id", "seat").agg(
        F.count("*").alias("renewals"))
    return runs.select("corpus_id", "seat", _start(F.col("w")).alias("start"), "renewals")


def occupancy(activity: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Distinct seats present per corpus in a sliding window; approximate on a stream."""
    seats = F.approx_count_distinct("seat", 0.01) if activity.isStreaming else F.count_distinct("seat")
    seen = timed(activity.filter("seat IS NOT NULL")).groupBy(F.window("ts", width, slide).alias("w"), "corpus_id").agg(seats.alias("seats"))
    return seen.select(_start(F.col("w")).alias("start"), "corpus_id", "seats")


def expire(items: DataFrame, now: Column, protected: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Items older than the time to live that nobody protects."""
    old = items.filter(F.col("ts") < F.timestamp_add("SECOND", F.lit(-ttl), now))
    return old.join(protected.select("event_id"), "event_id", "left_anti")
