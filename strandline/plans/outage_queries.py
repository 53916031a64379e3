"""Queries on outages. Buckets are days and gaps are 3 days, as events are sparse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, outages, scd2
from .base import query, ts

BUCKETS = """WITH buckets AS (SELECT link_pk, date_trunc('day', event_ts) AS bucket, count(*) FILTER (loss OR rtt_us = 0) * 100.0::DOUBLE / count(*) AS loss_pct, count(*) AS n FROM latency GROUP BY ALL HAVING count(*) >= 2),
flagged AS (SELECT *, loss_pct >= 10 AS flag, row_number() OVER (PARTITION BY link_pk ORDER BY bucket) - row_number() OVER (PARTITION BY link_pk, loss_pct >= 10 ORDER BY bucket) AS grp FROM buckets),
runs AS (SELECT link_pk, flag, grp, min(bucket) AS start_ts, max(bucket) AS last, max(loss_pct) AS peak, count(*) AS n_buckets FROM flagged GROUP BY ALL)
"""


def _buckets(t):
    return outages.loss_buckets(t.latency, bucket="1 day", least=2)


@query(BUCKETS + "SELECT link_pk, bucket, round(loss_pct, 4) AS loss_pct, n FROM buckets")
def loss_buckets(t):
    return _buckets(t).withColumn("loss_pct", F.round("loss_pct", 4))


LOSS = """SELECT link_pk, start_ts, last + INTERVAL 1 DAY AS end_ts, round(peak, 4) AS peak_loss_pct, n_buckets, CASE WHEN peak >= 60 THEN 'outage' ELSE 'degraded' END AS severity FROM runs WHERE flag AND n_buckets >= 2"""


def _loss(t):
    return outages.loss_outages(_buckets(t), bucket="1 day", severe=60.0).withColumn("peak_loss_pct", F.round("peak_loss_pct", 4))


@query(BUCKETS + LOSS)
def loss_outages(t):
    return _loss(t)


@query(
    BUCKETS
    + """, newest AS (SELECT *, max(last) OVER (PARTITION BY link_pk) AS top FROM runs)
SELECT link_pk, start_ts, round(peak, 4) AS peak_loss_pct, n_buckets FROM newest WHERE flag AND last = top AND n_buckets >= 2"""
)
def loss_ongoing(t):
    return outages.loss_ongoing(_buckets(t), threshold=10.0).withColumn("peak_loss_pct", F.round("peak_loss_pct", 4))


@query(
    BUCKETS
    + f""", outs AS ({LOSS}), cut AS (SELECT link_pk, start_ts, CASE WHEN link_pk % 7 = 0 AND n_buckets > 2 THEN NULL ELSE end_ts END AS end_ts, peak_loss_pct AS peak FROM outs),
reached AS (SELECT *, max(coalesce(end_ts, TIMESTAMP '9999-12-31')) OVER (PARTITION BY link_pk ORDER BY start_ts, end_ts NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cut),
marked AS (SELECT *, CASE WHEN reach IS NULL OR (reach < TIMESTAMP '9999-12-31' AND start_ts - reach >= INTERVAL 3 DAY) THEN 1 ELSE 0 END AS head FROM reached),
grouped AS (SELECT *, sum(head) OVER (PARTITION BY link_pk ORDER BY start_ts, end_ts NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM marked)
SELECT link_pk, min(start_ts) AS start_ts, CASE WHEN count(*) > count(end_ts) THEN NULL ELSE max(end_ts) END AS end_ts, max(peak) AS peak, count(*) AS n_merged FROM grouped GROUP BY link_pk, g"""
)
def coalesce_outages(t):
    cut = F.when((F.col("link_pk") % 7 == 0) & (F.col("n_buckets") > 2), None).otherwise(F.col("end_ts"))
    rows = _loss(t).select("link_pk", "start_ts", cut.alias("end_ts"), F.col("peak_loss_pct").alias("peak"))
    return outages.coalesce_outages(rows, gap="3 DAYS")


SESSIONS = """WITH marked AS (SELECT *, status <> 'activated' AS down, lag(status <> 'activated') OVER (PARTITION BY entity_id ORDER BY snapshot_ts, op_id) AS was FROM history),
numbered AS (SELECT *, sum(CASE WHEN down AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, op_id ROWS UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (SELECT entity_id, session, min(snapshot_ts) AS start_ts, min(snapshot_ts) FILTER (NOT down) AS end_ts, bool_or(status = 'hard-drained') FILTER (down) AS hard FROM numbered WHERE session > 0 GROUP BY ALL)
"""


@query(SESSIONS + "SELECT entity_id, start_ts, end_ts, hard, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS seconds FROM sessions")
def status_outages(t):
    return outages.status_outages(t.history)


@query(SESSIONS + "SELECT entity_id AS link_pk, start_ts, end_ts FROM sessions")
def drained_periods(t):
    return outages.drained_periods(t.history)


@query(
    """WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts DESC, ingested_at DESC, op_id DESC) AS n FROM history) WHERE n = 1),
tr AS (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, ingested_at, op_id) AS previous FROM history),
since AS (SELECT entity_id, max(snapshot_ts) AS since FROM tr WHERE previous = 'activated' AND status <> 'activated' GROUP BY entity_id)
SELECT cur.entity_id, cur.status, since.since FROM cur LEFT JOIN since USING (entity_id) WHERE cur.status <> 'activated'"""
)
def drained_now(t):
    return outages.drained_now(scd2.latest(t.history), scd2.status_transitions(t.history))


GAPS = """WITH days AS (SELECT DISTINCT link_pk, date_trunc('day', event_ts) AS bucket FROM latency),
following AS (SELECT *, lead(bucket) OVER (PARTITION BY link_pk ORDER BY bucket) AS end_ts FROM days),
gaps AS (SELECT link_pk, bucket + INTERVAL 1 DAY AS start_ts, end_ts FROM following WHERE end_ts - bucket >= INTERVAL 3 DAY)
"""


def _gaps(t):
    return outages.no_data_gaps(t.latency, bucket="1 day", gap="3 days")


@query(GAPS + "SELECT * FROM gaps")
def no_data_gaps(t):
    return _gaps(t)


@query(
    GAPS
    + """, periods AS (SELECT link_pk, TIMESTAMP '2024-01-05' + CAST(link_pk % 20 AS INT) * INTERVAL 1 DAY AS p_start, CASE WHEN link_pk % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-09' + CAST(link_pk % 20 AS INT) * INTERVAL 1 DAY END AS p_end FROM links)
SELECT g.* FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM periods p WHERE p.link_pk = g.link_pk AND (g.start_ts < p.p_end OR p.p_end IS NULL) AND g.end_ts > p.p_start)"""
)
def no_data_outages(t):
    shift = F.make_dt_interval((F.col("link_pk") % 20).cast("int"))
    end = F.when(F.col("link_pk") % 4 != 0, ts("2024-01-09") + shift)
    periods = t.links.select("link_pk", (ts("2024-01-05") + shift).alias("start_ts"), end.alias("end_ts"))
    return joins.overlap_anti(_gaps(t), periods, ["link_pk"])


@query(
    """SELECT link_pk, max(event_ts) AS last_seen FROM latency WHERE event_ts <= TIMESTAMP '2024-01-29' AND link_pk NOT IN (SELECT link_pk FROM links WHERE status <> 'activated')
GROUP BY link_pk HAVING max(event_ts) <= TIMESTAMP '2024-01-28' AND max(event_ts) >= TIMESTAMP '2023-12-30'"""
)
def no_data_now(t):
    drained = t.links.filter("status <> 'activated'")
    return outages.no_data_now(t.latency, drained, as_of=ts("2024-01-29"), after="1 DAY")


REPORT = BUCKETS + ", " + SESSIONS[5:] + ", " + GAPS[5:] + """, report AS (
  SELECT 'loss' AS kind, link_pk, start_ts, last + INTERVAL 1 DAY AS end_ts FROM runs WHERE flag AND n_buckets >= 2
  UNION ALL SELECT 'status', CAST(entity_id AS BIGINT), start_ts, end_ts FROM sessions UNION ALL SELECT 'no_data', * FROM gaps)
"""


def _report(t):
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), F.col("link_pk").cast("long").alias("link_pk"), "start_ts", "end_ts")
    return outages.outage_report(kind(_loss(t), "loss"), kind(outages.drained_periods(t.history), "status"), kind(_gaps(t), "no_data"))


@query(REPORT + "SELECT r.kind, r.link_pk, l.code, r.start_ts, r.end_ts, r.end_ts IS NULL AS ongoing FROM report r JOIN links l USING (link_pk) WHERE l.side_a = 3 OR l.side_z = 3")
def outage_report(t):
    return outages.for_items(_report(t), t.links, metro=3)


@query(REPORT + "SELECT r.kind, r.link_pk, l.code, r.start_ts, r.end_ts, r.end_ts IS NULL AS ongoing FROM report r JOIN links l USING (link_pk) WHERE l.contributor_pk = 2 AND l.link_pk IN (SELECT link_pk FROM counters WHERE device_pk = 5)")
def outage_report_items(t):
    return outages.for_items(_report(t), t.links, contributor=2, device=5, ends=t.counters.select("link_pk", "device_pk"))


@query(REPORT + "SELECT kind, count(*) AS n, count(*) FILTER (end_ts IS NULL) AS n_ongoing, count(DISTINCT link_pk) AS n_links FROM report GROUP BY kind")
def outage_counts(t):
    return outages.outage_counts(_report(t))


@query(REPORT + """SELECT kind, link_pk, CASE kind WHEN 'loss' THEN 'packet loss' WHEN 'status' THEN 'drained' ELSE 'no data' END || ' for ' || coalesce(CAST(epoch_us(end_ts) // 60000000 - epoch_us(start_ts) // 60000000 AS VARCHAR) || ' min', 'now') AS detail FROM report""")
def csv_export(t):
    from ..sources.tables import outage_csv_rows

    return outage_csv_rows(_report(t)).select("kind", "link_pk", "detail")
