"""Queries run as streams over the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import state_table
from ..sources.shared import shared_dir
from ..streaming import streams
from .base import query, ts


#: Times at which deliveries end.
ENDS = ("2024-01-11", "2024-01-21", "2024-03-01")
PART = "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


def _deliveries(t, run):
    """Events come in three deliveries, by time. After each, run(stream, root) takes what is new and goes on from its checkpoint."""
    root, begin = f"{shared_dir(t.spark)}/events-{uuid.uuid4().hex}", ts("2000-01-01")
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    for end in map(ts, ENDS):
        events.filter((F.col("ts") >= begin) & (F.col("ts") < end)).write.mode("append").parquet(f"{root}/in")
        out, begin = run(streams.read_stream(t.spark, f"{root}/in", "*.parquet", events.schema), f"{root}/run"), end
    return out


@query("SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events")
def stream_dedup(t):
    def run(rows, root):
        rows = rows.withColumn("day", F.date_trunc("day", "ts"))
        return streams.run_available(streams.dedup(rows, ["user_id", "day"], "ts", "40 days").select("user_id", "day"), root=root)

    return _deliveries(t, run)


@query("SELECT user_id, date_trunc('week', ts) AS bucket, round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 6) AS loss_pct, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t):
    def run(rows, root):
        # Weeks from Mondays on span deliveries.
        rows = rows.withColumn("loss", F.col("event_type") == "error").withColumn("ts", F.col("ts") - F.expr("INTERVAL 4 DAY"))
        return streams.run_available(streams.tumbling(rows, "ts", "1 day", "7 days", "user_id"), mode="complete", root=root)

    out = streams.newest_batch(_deliveries(t, run), ["user_id", "bucket"])
    return out.select("user_id", (F.col("bucket") + F.expr("INTERVAL 4 DAY")).alias("bucket"), F.round("loss_pct", 6).alias("loss_pct"), "n")


@query(
    """WITH marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 DAY THEN 1 ELSE 0 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, min(ts) AS start_ts, max(ts) + INTERVAL 2 DAY AS end_ts, count(*) AS n FROM runs GROUP BY user_id, run HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_session(t):
    out = _deliveries(t, lambda rows, root: streams.run_available(streams.sessions(rows, "ts", "1 hour", "2 days", "user_id"), root=root))
    newest = t.events.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("watermark"))
    return out.crossJoin(F.broadcast(newest)).filter("end_ts <= watermark").drop("watermark")  # one row


PREVIOUS = "last_value(CASE WHEN {keep} THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _previous(t, keep):
    run = lambda rows, root: streams.with_previous(rows, "user_id", ["ts", "event_id"], "value", keep, ts="ts", ttl="90 DAY", root=root)
    return _deliveries(t, run)


@query(f"SELECT user_id, event_id, round(value - {PREVIOUS.format(keep='true')}, 6) AS delta FROM events")
def stream_counter_deltas(t):
    return _previous(t, F.lit(True)).select("user_id", "event_id", F.round(F.col("value") - F.col("previous"), 6).alias("delta"))


@query(f"SELECT user_id, event_id, CASE WHEN value > 50 THEN round(abs(value - {PREVIOUS.format(keep='value > 50')}), 6) END AS jitter FROM events")
def stream_jitter(t):
    jitter = F.when(F.col("value") > 50, F.round(F.abs(F.col("value") - F.col("previous")), 6))
    return _previous(t, F.col("value") > 50).select("user_id", "event_id", jitter.alias("jitter"))


@query(
    f"""WITH snaps AS (SELECT user_id, {PART} AS op_id, arg_max(CAST(floor(value / 20) AS BIGINT), (ts, event_id)) AS level FROM events WHERE event_type = 'error' GROUP BY ALL),
grid AS (SELECT u.user_id, p AS op_id, s.level, lag(s.level) OVER (PARTITION BY u.user_id ORDER BY p) AS was FROM (SELECT DISTINCT user_id FROM snaps) u CROSS JOIN range(0, 3) r(p) LEFT JOIN snaps s ON s.user_id = u.user_id AND s.op_id = p)
SELECT CAST(user_id AS VARCHAR) AS entity_id, op_id, CASE WHEN level IS NULL THEN 'deleted' WHEN was IS NULL THEN 'created' ELSE 'updated' END AS change, coalesce(level, was) AS level
FROM grid WHERE level IS DISTINCT FROM was"""
)
def stream_scd2(t):
    """Each delivery is a snapshot of the users with errors and of their last level; who is missing is deleted."""
    root = f"{shared_dir(t.spark)}/history-{uuid.uuid4().hex}"
    schema = "entity_id string, snapshot_ts timestamp, ingested_at timestamp, op_id long, is_deleted boolean, level long, change string"

    def step(batch, number):
        rows = batch.filter("event_type = 'error'")
        snapshot = rows.select(F.col("user_id").cast("string").alias("entity_id"), F.col("ts").alias("snapshot_ts"), F.col("ts").alias("ingested_at"), F.col("event_id").alias("op_id"), F.lit(False).alias("is_deleted"), F.floor(F.col("value") / 20).alias("level"))
        at = ts("2024-01-01") + F.make_interval(days=F.lit(number))
        new = state_table.delta(batch.sparkSession, root, schema, snapshot, ["level"], at=at, op_id=F.lit(number).cast("long"), missing_means_deleted=True)
        columns = [c.split(" ")[0] for c in schema.split(", ")]
        state_table.append(new.withColumn("ingested_at", F.col("snapshot_ts")).select(*columns), root, number)
        state_table.compact(batch.sparkSession, root, schema)

    _deliveries(t, lambda rows, at: streams.apply_batches(rows, step, root=at))
    return t.spark.read.schema(schema).parquet(f"{root}/log").select("entity_id", "op_id", "change", "level")


@query(
    """WITH arrivals AS (SELECT *, event_id + CASE WHEN event_id % 97 = 0 THEN 500 ELSE 0 END AS arrival FROM events),
seen AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arrivals)
SELECT event_id, newest FROM seen WHERE ts < newest - INTERVAL 6 HOUR"""
)
def stream_late_rows(t):
    arrival = F.col("event_id") + F.when(F.col("event_id") % 97 == 0, 500).otherwise(0)
    rows = t.events.withColumn("arrival", arrival * 1_000_000 + F.col("event_id") % 1_000_000)
    return streams.late_rows(rows, "ts", "arrival", "6 HOURS").select("event_id", "newest")
