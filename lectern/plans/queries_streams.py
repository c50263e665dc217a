"""Registered queries: activity, usage and streaming jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import session
from ..session import scratch_path
from ..streaming import activity as ac
from ..streaming import jobs, stateful
from .fixtures import activity_view
from .queries_build import LINES
from .registry import query


def settings(spark, **values):
    """Session settings for the length of one streaming run."""
    return session.settings(spark, {k.replace("__", "."): v for k, v in values.items()})


UTC = {"spark__sql__session__timeZone": "UTC"}
STATE = {k.replace(".", "__"): v for k, v in stateful.STATE_STORE.items()}


def stream_of(t):
    return activity_view(ac.read_events(t.spark, t.sf_dir))


FEED = "SELECT event_id, seat, event_type FROM activity WHERE ts >= TIMESTAMP '2024-01-20' AND corpus_id = 3 AND event_type = 'click'"
query("z1_activity_feed", FEED)(
    lambda t: ac.activity_feed(t.activity, "2024-01-20 00:00:00", 3, "click").select("event_id", "seat", "event_type"))


@query("z1b_activity_feed_stream", FEED)
def _(t):
    with settings(t.spark, **UTC):
        return jobs.run_to_table(ac.activity_feed(stream_of(t), "2024-01-20 00:00:00", 3, "click").select("event_id", "seat", "event_type"), "feed")


def latest(rows, *keys):
    """The last state of each key that an update stream has written."""
    rest = [c for c in rows.columns if c not in (*keys, "_batch", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("s")).select(*keys, *[F.col(f"s.{c}") for c in rest])


COUNTS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, corpus_id, event_type, count(*) AS n FROM activity GROUP BY 1, 2, 3"
query("z2_activity_counts", COUNTS)(lambda t: ac.activity_counts(t.activity))


@query("z2b_activity_counts_stream", COUNTS)
def _(t):
    with settings(t.spark, **UTC):
        out = jobs.run_to_table(ac.activity_counts(stream_of(t)), "counts", "update")
    return latest(out, "start", "corpus_id", "event_type")


DAILY = """WITH u AS (SELECT date_trunc('day', ts) AS day, seat, count(*) AS requests, sum(greatest(units, 0))::BIGINT AS units FROM activity WHERE seat IS NOT NULL GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS day, seat, requests, units, floor(greatest(requests / 100, units / 10000) * 100)::INT AS used_pct,
  requests >= 100 OR units >= 10000 AS over_cap, greatest(requests / 100, units / 10000) >= 0.8 AS warn FROM u"""
query("z3_daily_usage", DAILY)(lambda t: ac.daily_usage(t.activity))



@query("z3b_daily_usage_stream", DAILY)
def _(t):
    with settings(t.spark, **UTC):
        return latest(jobs.run_to_table(ac.daily_usage(stream_of(t)), "usage", "update"), "day", "seat")


ADMIT = """WITH a AS (SELECT event_id, seat, ts::DATE AS day, greatest(units, 0) AS u, ts FROM activity WHERE seat IS NOT NULL),
p AS (SELECT event_id, seat, day, count(*) OVER w AS prior_requests, coalesce(sum(u) OVER w, 0)::BIGINT AS prior_units FROM a
  WINDOW w AS (PARTITION BY seat, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
query("w7_usage_admission", f"{ADMIT} SELECT *, prior_requests < 100 AND prior_units < 10000 AS admitted FROM p")(
    lambda t: jobs.usage_admission(t.activity))


@query("w8_running_quota", f"""{ADMIT} SELECT event_id, floor(greatest((prior_requests + 1) / 100, (prior_units + u) / 10000) * 100)::INT AS used_pct,
  greatest((prior_requests + 1) / 100, (prior_units + u) / 10000) >= 0.8 AS warn FROM p JOIN (SELECT event_id, u FROM a) USING (event_id)""")
def _(t):
    before = jobs.usage_admission(t.activity).join(t.activity.select("event_id", F.greatest("units", F.lit(0)).alias("u")), "event_id")
    running = before.withColumn("requests", F.col("prior_requests") + 1).withColumn("units", F.col("prior_units") + F.col("u"))
    return ac.with_quota(running).select("event_id", "used_pct", "warn")


# a verdict is given once the watermark has passed its request, or once a hundred others are known to precede it
@query("z4_usage_admit_stateful", f"""{ADMIT}, w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM a)
SELECT event_id, seat, strftime(day, '%Y-%m-%d') AS day, prior_requests < 100 AND prior_units < 10000 AS admitted
FROM p JOIN (SELECT event_id, ts FROM a) USING (event_id), w WHERE ts <= mark OR prior_requests >= 100""")
def _(t):
    with settings(t.spark, **UTC, **STATE):
        return jobs.run_to_table(stateful.admit_stream(stream_of(t)), "admit")


ATTENTION = """
SELECT seat, substr(sha256(props || event_type), 1, 16) AS content_key, count(*) AS touches, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM activity
WHERE seat IS NOT NULL GROUP BY 1, 2"""


def attention(activity):
    return ac.seat_attention(activity, F.concat("props", "event_type")).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


query("z5_seat_attention", ATTENTION)(lambda t: attention(t.activity))


@query("z5b_seat_attention_stream", ATTENTION)
def _(t):
    with settings(t.spark, **UTC):
        return latest(jobs.run_to_table(attention(stream_of(t)), "attention", "update"), "seat", "content_key")


SESSIONS = """
WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY corpus_id, seat ORDER BY ts, event_id) AS p FROM activity WHERE seat IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 90 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY corpus_id, seat ORDER BY ts, event_id) AS k FROM o)
SELECT corpus_id, seat, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS renewals FROM s GROUP BY corpus_id, seat, k"""
query("z6_writer_sessions", SESSIONS)(lambda t: ac.writer_sessions(t.activity))


# a stream emits a session once the watermark has passed its end
@query("z6b_writer_sessions_stream", SESSIONS + " HAVING max(ts) + INTERVAL 90 SECOND <= (SELECT max(ts) FROM o) - INTERVAL 10 MINUTE")
def _(t):
    with settings(t.spark, **UTC):
        return jobs.run_to_table(ac.writer_sessions(stream_of(t)), "sessions")


query("z7_occupancy", """
WITH w AS (SELECT corpus_id, seat, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start FROM activity, range(4) r(i) WHERE seat IS NOT NULL)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, corpus_id, count(DISTINCT seat) AS seats FROM w GROUP BY 1, 2""")(
    lambda t: ac.occupancy(t.activity))
query("z8_expire", """
SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 3600 SECOND AND event_type <> 'purchase'""")(
    lambda t: ac.expire(t.events, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), t.events.filter("event_type = 'purchase'")).select("event_id", "event_type"))


@query("z8b_expire_stream", """
SELECT event_id FROM events, (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) WHERE event_type <> 'purchase' AND ts < mark - INTERVAL 3600 SECOND""")
def _(t):
    """Every event is stored, and a purchase is protected from then on."""
    events = ac.read_events(t.spark, t.sf_dir)
    kinds = F.when(F.col("event_type") == "purchase", F.array(F.lit("store"), F.lit("protect"))).otherwise(F.array(F.lit("store")))
    changes = events.select("event_id", "ts", F.explode(kinds).alias("kind"), F.col("event_type").alias("guard"))
    with settings(t.spark, **UTC, **STATE):
        return jobs.run_to_table(stateful.expire_stream(changes), "expired")


# equal texts have equal chunks, so each distinct text is cut once
@query("z9_stream_ingest", f"""
WITH RECURSIVE documents AS (SELECT sha256(text) AS doc_id, min(role) AS source, text FROM conversations WHERE trim(text) <> '' GROUP BY text),
{LINES.format(where="true")}
SELECT substr(sha256(text), 1, 16) AS content_key, min(source) AS source, text FROM parts GROUP BY 1, text""")
def _(t):
    stream = ac.read_events(t.spark, t.sf_dir, "conversations.parquet").filter("trim(text) <> ''")
    return jobs.ingest_stream(stream.select(F.col("role").alias("source"), "text"), size=300, overlap=50)


@query("z10_late_rows", """
WITH h AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, n, (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-10') AS rows_dropped
FROM h WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t):
    """Events stored in three folders, the latest days first. Lateness is judged by the watermark of the
    batch before the last, so the second folder still counts and the third is late."""
    path, files = scratch_path(t.spark, "out-of-order"), 8
    ts = F.col("ts")
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-10", "2024-01-20"))
    for name, days in (("1", ts >= last), ("2", (ts >= first) & (ts < last)), ("3", ts < first)):
        t.events.filter(days).repartition(files).write.parquet(f"{path}/{name}")
    with settings(t.spark, **UTC):
        stream = (t.spark.readStream.schema(t.events.schema).option("recursiveFileLookup", "true")
                  .option("maxFilesPerTrigger", files).parquet(path))
        windows, dropped = jobs.late_rows(stream)
    return windows.withColumn("rows_dropped", F.lit(dropped).cast("bigint"))
