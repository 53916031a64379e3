"""Queries on health and latency. Samples are sparse, so windows are days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health
from .base import query, ts

AS_OF = "2024-01-30"
R4 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})

HEALTH = """WITH stats AS (
  SELECT link_pk, count(*) FILTER (event_ts >= TIMESTAMP '2024-01-23') AS n_samples,
    count(*) FILTER (event_ts >= TIMESTAMP '2024-01-23' AND (loss OR rtt_us = 0)) * 100.0::DOUBLE / nullif(count(*) FILTER (event_ts >= TIMESTAMP '2024-01-23'), 0) AS loss_pct,
    avg(rtt_us) FILTER (event_ts >= TIMESTAMP '2024-01-23' AND NOT (loss OR rtt_us = 0)) AS avg_rtt_us,
    quantile_cont(rtt_us, 0.95) FILTER (event_ts >= TIMESTAMP '2024-01-23' AND NOT (loss OR rtt_us = 0)) AS p95_rtt_us, max(event_ts) AS last_seen,
    count(*) FILTER (event_ts >= TIMESTAMP '2024-01-29' AND (loss OR rtt_us = 0)) AS bad_now, count(*) FILTER (event_ts >= TIMESTAMP '2024-01-29' AND NOT (loss OR rtt_us = 0)) AS good_now
  FROM latency WHERE event_ts <= TIMESTAMP '2024-01-30' GROUP BY link_pk),
health AS (SELECT link_pk, code, status, coalesce(n_samples, 0) AS n_samples, loss_pct, avg_rtt_us, p95_rtt_us, committed_rtt_us, last_seen, status = 'soft-drained' AS is_soft_drained,
  status = 'hard-drained' AS is_hard_drained, delay_override_ns > 0 AS is_override, coalesce(avg_rtt_us > committed_rtt_us, false) AS exceeds_committed,
  last_seen IS NULL OR last_seen < TIMESTAMP '2024-01-28' AS is_dark, coalesce(bad_now > 0 AND good_now = 0, false) AS is_down FROM links LEFT JOIN stats USING (link_pk))
"""


def _health(t):
    return health.links_health(t.latency, t.links, as_of=ts(AS_OF), lookback="7 DAYS", recent="1 DAY", dark_after="2 DAYS")


@query(HEALTH + "SELECT * REPLACE (round(loss_pct, 6) AS loss_pct, round(avg_rtt_us, 6) AS avg_rtt_us, round(p95_rtt_us, 6) AS p95_rtt_us) FROM health")
def links_health(t):
    return R4(_health(t), "loss_pct", "avg_rtt_us", "p95_rtt_us")


SLA = "CASE WHEN loss_pct IS NULL THEN 'unknown' WHEN loss_pct >= 10 OR coalesce(avg_rtt_us / nullif(committed_rtt_us, 0), 0) >= 2 THEN 'critical' WHEN loss_pct >= 0.1 OR coalesce(avg_rtt_us / nullif(committed_rtt_us, 0), 0) >= 1.5 THEN 'warning' ELSE 'healthy' END"


@query(HEALTH + f"SELECT {SLA} AS sla, count(*) AS n FROM health GROUP BY 1")
def link_sla(t):
    return _health(t).groupBy(health.sla(F.col("loss_pct"), F.col("avg_rtt_us"), F.col("committed_rtt_us")).alias("sla")).agg(F.count("*").alias("n"))


CLASS = """CASE WHEN loss_pct >= 10 OR coalesce(CASE WHEN avg_rtt_us > 0 THEN (avg_rtt_us - committed_rtt_us) / committed_rtt_us * 100 END, 0) >= 50 THEN 'unhealthy'
  WHEN loss_pct >= 1 OR coalesce(CASE WHEN avg_rtt_us > 0 THEN (avg_rtt_us - committed_rtt_us) / committed_rtt_us * 100 END, 0) >= 20 THEN 'degraded' ELSE 'healthy' END"""


@query(HEALTH + f"SELECT link_pk, {CLASS} AS state FROM health WHERE loss_pct IS NOT NULL")
def classify_link(t):
    rows = _health(t).filter("loss_pct IS NOT NULL")
    return rows.select("link_pk", health.classify_link(F.col("avg_rtt_us"), F.col("loss_pct"), F.col("committed_rtt_us")).alias("state"))


HISTORY = f"""WITH stats AS (SELECT link_pk, date_trunc('day', event_ts) AS bucket, count(*) FILTER (loss OR rtt_us = 0) * 100.0::DOUBLE / count(*) AS loss_pct, avg(rtt_us) FILTER (NOT (loss OR rtt_us = 0)) AS avg_rtt_us
  FROM latency WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-25' GROUP BY ALL),
grid AS (SELECT s.* REPLACE (CASE WHEN link_type <> 'WAN' OR side_a = side_z THEN 0 ELSE committed_rtt_us END AS committed_rtt_us), b AS bucket, loss_pct, avg_rtt_us, coalesce(loss_pct >= 99.9, false) AS dead FROM links s CROSS JOIN generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY) g(b)
  LEFT JOIN stats ON stats.link_pk = s.link_pk AND stats.bucket = b),
runs AS (SELECT *, row_number() OVER (PARTITION BY link_pk ORDER BY bucket) - row_number() OVER (PARTITION BY link_pk, dead ORDER BY bucket) AS run FROM grid),
sized AS (SELECT *, count(*) OVER (PARTITION BY link_pk, dead, run) AS run_length FROM runs),
usage AS (SELECT link_pk, date_trunc('day', event_ts) + INTERVAL 27 YEAR AS bucket, greatest(sum(in_octets) * 8 / sum(seconds), sum(out_octets) * 8 / sum(seconds)) AS bps, sum(greatest(errors, 0)) AS errors, sum(greatest(discards, 0)) AS discards, sum(greatest(carrier, 0)) AS carrier
  FROM counters GROUP BY ALL),
sorted AS (SELECT s.*, CASE WHEN status <> 'activated' OR (dead AND run_length >= 2) THEN 'disabled' WHEN loss_pct IS NULL THEN 'no_data' ELSE {CLASS.replace("/ committed_rtt_us", "/ nullif(committed_rtt_us, 0)")} END AS state, bps, errors, discards, carrier FROM sized s LEFT JOIN usage USING (link_pk, bucket)),
history_rows AS (SELECT link_pk, bucket, CASE WHEN state IN ('healthy', 'degraded') AND (errors >= 100 OR discards >= 100 OR carrier >= 100) THEN 'unhealthy'
    WHEN state = 'healthy' AND (errors > 0 OR discards > 0 OR carrier > 0 OR bps * 100.0 / bandwidth_bps > 80) THEN 'degraded' ELSE state END AS status,
  concat_ws(',', CASE WHEN status <> 'activated' THEN 'drained' END, CASE WHEN loss_pct >= 1 THEN 'packet_loss' END, CASE WHEN (avg_rtt_us - committed_rtt_us) * 100 / nullif(committed_rtt_us, 0) >= 20 THEN 'high_latency' END,
    CASE WHEN loss_pct IS NULL THEN 'no_data' END, CASE WHEN dead AND run_length >= 2 THEN 'dead' END,
    CASE WHEN errors > 0 THEN 'interface_errors' END, CASE WHEN discards > 0 THEN 'discards' END, CASE WHEN carrier > 0 THEN 'carrier_transitions' END, CASE WHEN bps * 100.0 / bandwidth_bps > 80 THEN 'high_utilization' END) AS reasons FROM sorted)
"""


def _history(t):
    # Shipments end where samples begin: their years are moved, so that counters and samples of a link meet.
    counters = t.counters.withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 27 YEAR"))
    usage = health.link_usage(counters, t.links, bucket="1 DAY")
    return health.link_history(t.latency, t.links, start=ts("2024-01-05"), end=ts("2024-01-25"), bucket="1 DAY", usage=usage)


@query(HISTORY + "SELECT * FROM history_rows")
def link_history(t):
    return _history(t).withColumn("reasons", F.array_join("reasons", ","))


@query(HISTORY + "SELECT bucket, status FROM history_rows WHERE link_pk = 7")
def single_link_history(t):
    return _history(t).filter("link_pk = 7").select("bucket", "status")


NOW = HEALTH + f""", promised AS (SELECT h.* REPLACE (CASE WHEN link_type <> 'WAN' OR side_a = side_z THEN 0 ELSE l.committed_rtt_us END AS committed_rtt_us) FROM health h JOIN links l USING (link_pk)),
now AS (SELECT link_pk, code, CASE WHEN status <> 'activated' THEN 'disabled' WHEN loss_pct IS NULL THEN 'no_data' ELSE {CLASS.replace("/ committed_rtt_us", "/ nullif(committed_rtt_us, 0)")} END AS status, loss_pct,
  CASE WHEN avg_rtt_us > 0 THEN (avg_rtt_us - committed_rtt_us) * 100 / nullif(committed_rtt_us, 0) END AS over_pct FROM promised)
"""


def _now(t):
    return health.links_now(_health(t), t.links)


@query(
    NOW
    + """, counted AS (SELECT device_pk, sum(greatest(errors, 0)) AS e, sum(greatest(discards, 0)) AS d, sum(greatest(carrier, 0)) AS c FROM counters WHERE event_ts >= TIMESTAMP '1998-06-01' GROUP BY 1),
device_states AS (SELECT CASE WHEN status <> 'activated' THEN 'disabled' WHEN greatest(e, d, c) >= 100 THEN 'unhealthy' WHEN greatest(e, d, c) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM counted JOIN devices USING (device_pk)),
share AS (SELECT count(*) FILTER (status = 'unhealthy') * 100.0 / count(*) AS bad, count(*) FILTER (status = 'degraded') * 100.0 / count(*) AS worn FROM now),
lost AS (SELECT count(*) FILTER (loss OR rtt_us = 0) * 100.0 / count(*) AS pct FROM latency WHERE event_ts <= TIMESTAMP '2024-01-30' AND event_ts > TIMESTAMP '2024-01-23' AND link_pk IN (SELECT link_pk FROM links WHERE link_type = 'WAN'))
SELECT kind, status, n, CASE WHEN bad > 10 THEN 'unhealthy' WHEN worn > 20 OR bad > 0 THEN 'degraded' WHEN pct >= 10 THEN 'unhealthy' WHEN pct >= 1 THEN 'degraded' ELSE 'healthy' END AS verdict
FROM (SELECT 'link' AS kind, status, count(*) AS n FROM now GROUP BY status UNION ALL SELECT 'device', status, count(*) FROM device_states GROUP BY status), share, lost"""
)
def network_status(t):
    late = t.counters.filter(F.col("event_ts") >= ts("1998-06-01"))
    devices = health.device_history(late.withColumn("event_ts", ts("1998-06-01")), t.devices, bucket="month")
    return health.network_status(_now(t), devices, health.network_performance(t.latency, t.links, as_of=ts(AS_OF), lookback="7 DAYS"))


@query(
    NOW
    + """SELECT link_pk, code, issue, round(value, 6) AS value, threshold FROM (SELECT link_pk, code, 'packet_loss' AS issue, loss_pct AS value, 1.0::DOUBLE AS threshold FROM now WHERE status <> 'disabled' AND loss_pct >= 1
  UNION ALL SELECT link_pk, code, 'high_latency', over_pct, 20.0 FROM now WHERE status <> 'disabled' AND over_pct >= 20) ORDER BY value DESC, link_pk, issue LIMIT 25"""
)
def network_top_issues(t):
    return health.top_issues(_now(t), 25).withColumn("value", F.round("value", 6))


@query(
    """WITH used AS (SELECT link_pk, date_trunc('day', event_ts) AS bucket, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o FROM counters GROUP BY ALL),
pct AS (SELECT link_pk, bucket, i * 100.0 / bandwidth_bps AS in_pct, o * 100.0 / bandwidth_bps AS out_pct FROM used JOIN links USING (link_pk))
SELECT link_pk, bucket, round(in_pct, 6) AS in_pct, round(out_pct, 6) AS out_pct, greatest(in_pct, out_pct) >= 70 AS is_high FROM pct ORDER BY greatest(in_pct, out_pct) DESC, link_pk, bucket LIMIT 50"""
)
def busiest_links(t):
    return R4(health.busiest_links(health.link_usage(t.counters, t.links, bucket="1 DAY"), 50), "in_pct", "out_pct")


DEVICE = """WITH sums AS (SELECT device_pk, date_trunc('month', event_ts) AS bucket, CAST(sum(greatest(errors, 0)) AS BIGINT) AS errors, CAST(sum(greatest(discards, 0)) AS BIGINT) AS discards,
  CAST(sum(greatest(carrier, 0)) AS BIGINT) AS carrier FROM counters GROUP BY ALL)
SELECT s.device_pk, bucket, errors, discards, carrier, CASE WHEN d.status <> 'activated' THEN 'disabled' WHEN errors >= 100 OR discards >= 100 OR carrier >= 100 THEN 'unhealthy'
  WHEN errors > 0 OR discards > 0 OR carrier > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM sums s JOIN devices d USING (device_pk)"""


@query(DEVICE)
def device_history(t):
    return health.device_history(t.counters, t.devices, bucket="month")


@query(DEVICE + " WHERE s.device_pk = 5")
def single_device_history(t):
    return health.device_history(t.counters.filter("device_pk = 5"), t.devices, bucket="month")


@query("SELECT device_pk, intf, date_trunc('quarter', event_ts) AS bucket, CAST(sum(greatest(errors, 0)) AS BIGINT) AS errors, CAST(sum(greatest(discards, 0)) AS BIGINT) AS discards, CAST(sum(greatest(carrier, 0)) AS BIGINT) AS carrier FROM counters GROUP BY ALL")
def device_interface_history(t):
    return health.interface_history(t.counters, bucket="quarter")


@query(
    """SELECT round(avg(rtt_us) FILTER (NOT lost), 6) AS avg_rtt_us, round(quantile_cont(rtt_us, 0.95) FILTER (NOT lost), 6) AS p95_rtt_us, min(rtt_us) FILTER (NOT lost) AS min_rtt_us, max(rtt_us) FILTER (NOT lost) AS max_rtt_us,
  round(count(*) FILTER (lost) * 100.0::DOUBLE / count(*), 6) AS loss_pct, count(*) AS n, round(avg(ipdv_us), 6) AS avg_jitter_us, round(quantile_cont(ipdv_us, 0.95), 6) AS p95_jitter_us, max(ipdv_us) AS max_jitter_us
FROM (SELECT *, loss OR rtt_us = 0 AS lost FROM jittered WHERE event_ts <= TIMESTAMP '2024-01-30' AND event_ts > TIMESTAMP '2024-01-20' AND link_pk IN (SELECT link_pk FROM links WHERE link_type = 'WAN'))"""
)
def network_performance(t):
    rows = health.network_performance(t.jittered, t.links, as_of=ts(AS_OF), lookback="10 DAYS")
    return R4(rows, "avg_rtt_us", "p95_rtt_us", "loss_pct", "avg_jitter_us", "p95_jitter_us")


@query(
    """WITH days AS (SELECT link_pk, date_trunc('day', event_ts) AS bucket, count(*) FILTER (loss OR rtt_us = 0) * 100.0 / count(*) >= 1 AS bad FROM latency WHERE event_ts <= TIMESTAMP '2024-01-30' AND event_ts > TIMESTAMP '2024-01-10' GROUP BY ALL),
f AS (SELECT link_pk, max(bucket) FILTER (NOT bad) AS last_good, min(bucket) FILTER (bad) AS first_bad, max(bucket) FILTER (bad) AS last_bad FROM days GROUP BY link_pk)
SELECT link_pk, coalesce(last_good + INTERVAL 1 DAY, first_bad) AS since FROM f WHERE last_bad IS NOT NULL AND (last_good IS NULL OR last_bad > last_good)"""
)
def issue_since(t):
    return health.issue_since(t.latency, as_of=ts(AS_OF), lookback="20 DAYS", bucket="day")


PAIRS = """WITH samples AS (SELECT l.event_ts, k.side_a AS x, k.side_z AS y, l.rtt_us, l.loss, l.ipdv_us, e.event_type FROM jittered l JOIN links k USING (link_pk) JOIN events e ON e.event_id = l.sample_index WHERE k.side_a <> k.side_z),
agg AS (SELECT least(x, y) AS metro1, greatest(x, y) AS metro2, event_type = 'click' AS overlay, avg(rtt_us) FILTER (NOT loss AND rtt_us > 0) AS a, quantile_cont(rtt_us, 0.95) FILTER (NOT loss AND rtt_us > 0) AS p,
  count(*) FILTER (loss OR rtt_us = 0) * 100.0::DOUBLE / count(*) AS l, count(*) AS n, avg(ipdv_us) AS j FROM samples WHERE event_type IN ('click', 'view') GROUP BY ALL),
pairs AS (SELECT coalesce(o.metro1, i.metro1) AS metro1, coalesce(o.metro2, i.metro2) AS metro2, o.a AS overlay_avg, o.p AS overlay_p95, o.l AS overlay_loss_pct, o.n AS overlay_n, i.a AS other_avg, i.p AS other_p95, i.l AS other_loss_pct, i.n AS other_n, o.j AS overlay_avg_jitter_us, i.j AS other_avg_jitter_us,
  (i.a - o.a) * 100 / i.a AS improvement_pct FROM (SELECT * FROM agg WHERE overlay) o FULL JOIN (SELECT * FROM agg WHERE NOT overlay) i ON o.metro1 = i.metro1 AND o.metro2 = i.metro2)
"""


def _samples(t):
    kind = t.events.select(F.col("event_id").alias("sample_index"), "event_type")
    rows = t.jittered.join(t.links, "link_pk").filter("side_a <> side_z").join(kind, "sample_index")
    return rows.select("event_ts", F.col("side_a").alias("x"), F.col("side_z").alias("y"), "rtt_us", "loss", "ipdv_us", "event_type")


def _pairs(t):
    rows = _samples(t)
    return health.overlay_vs_other(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"))


NUMBERS = ("overlay_avg", "overlay_p95", "overlay_loss_pct", "other_avg", "other_p95", "other_loss_pct", "improvement_pct", "overlay_avg_jitter_us", "other_avg_jitter_us")


@query(PAIRS + f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)}) FROM pairs")
def overlay_vs_internet(t):
    return R4(_pairs(t), *NUMBERS)


@query(PAIRS + "SELECT count(*) AS n_pairs, count(*) FILTER (overlay_avg IS NOT NULL AND other_avg IS NOT NULL) AS n_both, round(avg(improvement_pct), 6) AS avg_improvement_pct, round(max(improvement_pct), 6) AS max_improvement_pct, count(*) FILTER (improvement_pct > 0) AS n_faster FROM pairs")
def latency_comparison_summary(t):
    return R4(health.comparison_summary(_pairs(t)), "avg_improvement_pct", "max_improvement_pct")


@query(
    PAIRS
    + """, one AS (SELECT * FROM samples WHERE least(x, y) = 2 AND greatest(x, y) <= 12),
spine AS (SELECT b AS bucket FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(b))
SELECT bucket, round(avg(rtt_us) FILTER (event_type = 'click'), 6) AS overlay_us, round(avg(rtt_us) FILTER (event_type = 'view'), 6) AS other_us FROM spine LEFT JOIN one ON date_trunc('day', event_ts) = bucket GROUP BY bucket"""
)
def latency_history_pair(t):
    rows = _samples(t).filter("least(x, y) = 2 AND greatest(x, y) <= 12")
    frame = t.region.limit(1)
    out = health.latency_history_pair(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), start=ts("2024-01-01"), end=ts("2024-01-31"), bucket="1 DAY", spark_frame=frame)
    return R4(out, "overlay_us", "other_us")


@query(
    """WITH rows AS (SELECT *, loss OR rtt_us = 0 AS lost, date_trunc('week', event_ts) AS bucket, date_trunc('day', event_ts) AS sub FROM jittered WHERE link_pk IN (SELECT link_pk FROM links)),
worst AS (SELECT link_pk, bucket, max(p) AS loss_pct FROM (SELECT link_pk, bucket, sub, count(*) FILTER (lost) * 100.0::DOUBLE / count(*) AS p FROM rows GROUP BY ALL) GROUP BY ALL)
SELECT link_pk, bucket, round(avg(rtt_us) FILTER (NOT lost), 6) AS avg_rtt_us, round(quantile_cont(rtt_us, 0.95) FILTER (NOT lost), 6) AS p95_rtt_us, round(avg(rtt_us) FILTER (NOT lost AND direction = 0), 6) AS a_to_z_us,
  round(avg(rtt_us) FILTER (NOT lost AND direction = 1), 6) AS z_to_a_us, round(any_value(loss_pct), 6) AS loss_pct, round(avg(ipdv_us), 6) AS avg_jitter_us, round(quantile_cont(ipdv_us, 0.95), 6) AS p95_jitter_us, max(ipdv_us) AS max_jitter_us FROM rows JOIN worst USING (link_pk, bucket) GROUP BY link_pk, bucket"""
)
def link_latency_series(t):
    return R4(health.latency_series(t.jittered, t.links, bucket="week", sub="day"), "avg_rtt_us", "p95_rtt_us", "a_to_z_us", "z_to_a_us", "loss_pct", "avg_jitter_us", "p95_jitter_us")


@query("SELECT link_pk, date_trunc('day', event_ts) AS bucket, round(count(*) FILTER (loss OR rtt_us = 0) * 100.0::DOUBLE / count(*), 6) AS loss_pct, count(*) AS n FROM latency GROUP BY ALL HAVING count(*) FILTER (loss OR rtt_us = 0) * 100.0 / count(*) >= 1")
def historical_loss(t):
    return R4(health.historical_loss(t.latency, grain="day", least_pct=1.0), "loss_pct")


@query(
    """SELECT least(side_a, side_z) AS metro1, greatest(side_a, side_z) AS metro2, date_trunc('day', event_ts) AS bucket, round(count(*) FILTER (loss OR rtt_us = 0) * 100.0::DOUBLE / count(*), 6) AS loss_pct, count(*) AS n
FROM latency JOIN links USING (link_pk) GROUP BY ALL HAVING count(*) FILTER (loss OR rtt_us = 0) * 100.0 / count(*) >= 1"""
)
def historical_loss_metros(t):
    return R4(health.historical_loss(t.latency, grain="day", least_pct=1.0, metros=t.links), "loss_pct")


@query(
    """WITH alerts AS (SELECT 'link' AS kind, link_pk AS pk, code, CASE WHEN status = 'activated' THEN 'soft-drained' ELSE status END AS status FROM links WHERE status <> 'activated' OR delay_override_ns > 0
  UNION ALL SELECT 'device', device_pk, code, status FROM devices WHERE status <> 'activated'),
lg AS (SELECT entity_id, snapshot_ts, status, lag(status) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, ingested_at, op_id) AS was FROM history),
since AS (SELECT CAST(entity_id AS BIGINT) AS pk, max(snapshot_ts) AS since FROM lg WHERE was IS NOT NULL AND status <> was GROUP BY 1)
SELECT a.kind, a.pk, a.code, a.status, s.since FROM alerts a LEFT JOIN since s ON a.kind = 'link' AND s.pk = a.pk ORDER BY s.since DESC NULLS LAST, a.kind, a.pk LIMIT 50"""
)
def alerts_since(t):
    from ..operators import scd2

    moves = scd2.status_transitions(t.history, "status").select(F.lit("link").alias("kind"), F.col("entity_id").cast("long").alias("pk"), "at")
    return health.alerts_since(health.non_activated(t.links, t.devices), moves, 50).select("kind", "pk", "code", "status", "since")


@query("SELECT 'link' AS kind, link_pk AS pk, code, CASE WHEN status = 'activated' THEN 'soft-drained' ELSE status END AS status FROM links WHERE status <> 'activated' OR delay_override_ns > 0 UNION ALL SELECT 'device', device_pk, code, status FROM devices WHERE status <> 'activated'")
def non_activated_alerts(t):
    return health.non_activated(t.links, t.devices)


@query("SELECT device_pk, CAST(n AS BIGINT) AS n_users, max_users, round(n * 100.0::DOUBLE / max_users, 6) AS used_pct FROM (SELECT device_pk, max_users, count(*) AS n FROM devices d JOIN links l ON l.side_a = d.metro_pk AND l.link_pk % 7 = d.device_pk % 7 GROUP BY ALL) ORDER BY n * 100.0 / max_users DESC, device_pk LIMIT 100")
def top_device_utilization(t):
    users = t.links.groupBy(F.col("side_a").alias("metro_pk"), (F.col("link_pk") % 7).alias("k")).agg(F.count("*").alias("n_users"))
    devices = t.devices.withColumn("k", F.col("device_pk") % 7)
    rows = devices.join(F.broadcast(users), ["metro_pk", "k"])  # a row for each of 25 metros and 7 remainders
    rows = rows.groupBy("device_pk", "max_users").agg(F.sum("n_users").alias("n_users"))
    rows = rows.withColumn("used_pct", F.col("n_users") * 100.0 / F.col("max_users"))
    return R4(rows.orderBy(F.col("used_pct").desc(), "device_pk").limit(100), "used_pct")
