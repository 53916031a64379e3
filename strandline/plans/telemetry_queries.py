"""Queries on facts and what is derived from previous rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sketches
from ..operators import facts, geo, joins
from .base import query, ts

SAMPLE_ORDER = ["event_ts", "sample_index"]


@query("SELECT event_ts, link_pk, sample_index, rtt_us FROM latency WHERE event_ts >= TIMESTAMP '2024-01-10' AND event_ts < TIMESTAMP '2024-01-12' AND NOT loss")
def fact_get_rows(t):
    rows = facts.get_rows(t.latency, start=ts("2024-01-10"), end=ts("2024-01-12"), where=~F.col("loss"))
    return rows.select("event_ts", "link_pk", "sample_index", "rtt_us")


@query("SELECT user_id, date_trunc('day', ts) AS day, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedup_latest(t):
    rows = t.events.select("user_id", F.date_trunc("day", "ts").alias("day"), "ts", "event_id")
    return facts.dedup_latest(rows, ["user_id", "day"], ["ts", "event_id"]).drop("ts")


@query("SELECT min(event_ts) AS min_ts, max(event_ts) AS max_ts, count(*) AS n_rows, min(sample_index) AS min_epoch, max(sample_index) AS max_epoch FROM latency")
def data_boundaries(t):
    return facts.boundaries(t.latency, epoch="sample_index")


COUNTERS = """WITH marked AS (SELECT user_id AS device, ts AS event_ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents, event_type FROM events),
raw_counts AS (SELECT device, event_ts, event_id, CAST(sum(cents) OVER (PARTITION BY device ORDER BY event_ts, event_id) AS BIGINT) AS octets,
  CASE WHEN event_type = 'error' THEN CAST(sum(cents) OVER (PARTITION BY device ORDER BY event_ts, event_id) AS BIGINT) END AS errors FROM marked)
"""


def _raw_counters(t):
    from pyspark.sql import Window

    w = Window.partitionBy("device").orderBy("event_ts", "event_id")
    rows = t.events.select(F.col("user_id").alias("device"), F.col("ts").alias("event_ts"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_type")
    rows = rows.withColumn("octets", F.sum("cents").over(w))
    return rows.withColumn("errors", F.when(F.col("event_type") == "error", F.col("octets"))).select("device", "event_ts", "event_id", "octets", "errors")


@query(
    COUNTERS
    + """, deltas AS (SELECT *, row_number() OVER w AS n, octets - lag(octets) OVER w AS octets_delta,
  errors - last_value(errors IGNORE NULLS) OVER (PARTITION BY device ORDER BY event_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS errors_delta,
  (epoch_us(event_ts) - epoch_us(lag(event_ts) OVER w)) / 1e6 AS delta_seconds FROM raw_counts WINDOW w AS (PARTITION BY device ORDER BY event_ts, event_id))
SELECT device, event_id, octets_delta, errors_delta, delta_seconds FROM deltas WHERE n > 1"""
)
def counter_deltas(t):
    rows = facts.counter_deltas(_raw_counters(t), ["device"], ["event_ts", "event_id"], ["octets", "errors"], sparse=("errors",))
    return rows.select("device", "event_id", "octets_delta", "errors_delta", "delta_seconds")


@query(
    COUNTERS
    + """SELECT device, arg_max(octets, event_ts) AS octets, arg_max(errors, event_ts) FILTER (errors IS NOT NULL) AS errors FROM raw_counts
WHERE event_ts < TIMESTAMP '2024-01-20' AND event_ts >= TIMESTAMP '2024-01-10' GROUP BY device"""
)
def counter_baselines(t):
    return facts.counter_baselines(_raw_counters(t), ["device"], ["octets", "errors"], ts("2024-01-20"), "10 DAYS")


@query(
    COUNTERS
    + """, base AS (SELECT device, arg_max(octets, event_ts) AS octets FROM raw_counts WHERE event_ts < TIMESTAMP '2024-01-20' GROUP BY device),
late AS (SELECT r.*, row_number() OVER w AS n, coalesce(lag(r.octets) OVER w, b.octets) AS before FROM raw_counts r LEFT JOIN base b USING (device)
  WHERE event_ts >= TIMESTAMP '2024-01-20' WINDOW w AS (PARTITION BY device ORDER BY event_ts, event_id))
SELECT device, event_id, octets - before AS octets_delta FROM late WHERE before IS NOT NULL"""
)
def counter_deltas_resumed(t):
    raw = _raw_counters(t)
    base = facts.counter_baselines(raw, ["device"], ["octets"], ts("2024-01-20"), "90 DAYS")
    rows = facts.counter_deltas(raw.filter(F.col("event_ts") >= ts("2024-01-20")), ["device"], ["event_ts", "event_id"], ["octets"], baselines=base)
    return rows.select("device", "event_id", "octets_delta")


@query(
    """WITH lagged AS (SELECT *, last_value(CASE WHEN rtt_us > 0 THEN rtt_us END IGNORE NULLS) OVER (PARTITION BY link_pk, direction ORDER BY event_ts, sample_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM latency)
SELECT link_pk, direction, sample_index, round(CASE WHEN rtt_us > 0 THEN abs(rtt_us - was) END, 4) AS ipdv_us, rtt_us = 0 AS loss FROM lagged"""
)
def ipdv(t):
    rows = facts.ipdv(t.latency, ["link_pk", "direction"], SAMPLE_ORDER)
    return rows.select("link_pk", "direction", "sample_index", F.round("ipdv_us", 4).alias("ipdv_us"), "loss")


@query("SELECT link_pk, direction, arg_max(rtt_us, (event_ts, sample_index)) AS rtt_us FROM latency WHERE rtt_us > 0 GROUP BY ALL")
def previous_value(t):
    return facts.previous_value(t.latency, ["link_pk", "direction"], SAMPLE_ORDER)


@query("SELECT link_pk, direction, max(sample_index) AS max_index FROM latency GROUP BY ALL")
def max_sample_index(t):
    return facts.max_index(t.latency, ["link_pk", "direction"])


@query(
    """WITH top AS (SELECT link_pk, max(sample_index) AS top FROM latency WHERE event_ts < TIMESTAMP '2024-01-15' GROUP BY link_pk)
SELECT l.link_pk, l.sample_index FROM latency l LEFT JOIN top USING (link_pk) WHERE top IS NULL OR sample_index > top"""
)
def incremental_append(t):
    old = t.latency.filter(F.col("event_ts") < ts("2024-01-15"))
    return facts.incremental_append(t.latency, old, ["link_pk"]).select("link_pk", "sample_index")


@query(
    """WITH top AS (SELECT link_pk, max(event_ts) AS top FROM latency WHERE event_ts < TIMESTAMP '2024-01-20' GROUP BY link_pk)
SELECT l.link_pk, l.sample_index FROM latency l LEFT JOIN top USING (link_pk) WHERE top IS NULL OR event_ts > top"""
)
def skip_already_written(t):
    old = t.latency.filter(F.col("event_ts") < ts("2024-01-20"))
    return facts.skip_written(t.latency, old, ["link_pk"]).select("link_pk", "sample_index")


@query("SELECT max(event_ts) - INTERVAL 5 MINUTE AS read_from FROM latency")
def overlap_window(t):
    return facts.overlap_start(t.latency, ts("2024-02-01"))


@query("SELECT a.code AS origin, b.code AS target FROM metros a JOIN metros b ON a.code < b.code")
def metro_pairs(t):
    return facts.unordered_pairs(t.metros, "code")


@query(
    """WITH act AS (SELECT user_id AS account, event_id, CAST(date_part('day', ts) AS BIGINT) // 3 AS epoch, CAST(round(value) AS BIGINT) AS credits FROM events)
SELECT account, event_id, CASE WHEN lag(epoch) OVER w = epoch THEN greatest(credits - lag(credits) OVER w, 0) END AS credits_delta FROM act WINDOW w AS (PARTITION BY account ORDER BY event_id)"""
)
def credits_delta(t):
    rows = t.events.select(F.col("user_id").alias("account"), "event_id", F.floor(F.dayofmonth("ts") / 3).alias("epoch"), F.round("value").cast("long").alias("credits"))
    return facts.credits_delta(rows, "account", "event_id", "epoch", "credits").select("account", "event_id", "credits_delta")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS tunnel FROM lineitem")
def tunnel_id_extract(t):
    named = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "Tunnel").otherwise("Ethernet1/"), F.col("l_suppkey").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", facts.tunnel_id(named).alias("tunnel"))


LINK_SIDES = "SELECT link_pk, side_a AS device, 'A' AS side FROM links UNION ALL SELECT link_pk, side_z, 'Z' FROM links"


@query(f"SELECT device, 'if' || link_pk AS interface, link_pk, side FROM ({LINK_SIDES})")
def interface_link_lookup(t):
    named = F.concat(F.lit("if"), F.col("link_pk").cast("string"))
    return facts.interface_links(t.links.select("link_pk", F.col("side_a").alias("side_a_pk"), F.col("side_z").alias("side_z_pk"), named.alias("side_a_iface"), named.alias("side_z_iface")))


@query(
    """SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.ts AS matched_ts FROM events e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def asof_join(t):
    right = t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return joins.asof_join(t.events.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "ts", ["purchase_id"]).drop("ts")


@query(
    """SELECT e.event_id, CASE WHEN e.ts - p.ts <= INTERVAL 2 DAY THEN p.event_id END AS purchase_id FROM events e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def asof_join_tolerance(t):
    right = t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    rows = joins.asof_join(t.events.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "ts", ["purchase_id"], tolerance_seconds=2 * 86400)
    return rows.select("event_id", "purchase_id")


@query(
    """WITH direct AS (SELECT link_pk AS key, committed_rtt_us AS v FROM links WHERE link_pk % 3 = 0)
SELECT e.event_id, coalesce(d.v, p.v) AS v FROM events e LEFT JOIN direct d ON d.key = e.user_id LEFT JOIN direct p ON p.key = e.user_id // 2"""
)
def derived_key_fallback(t):
    direct = t.links.filter("link_pk % 3 = 0").select(F.col("link_pk").alias("key"), F.col("committed_rtt_us").alias("v"))
    rows = t.events.select("event_id", F.col("user_id").alias("key"))
    return joins.with_fallback(rows, direct, "key", F.expr("key DIV 2"), "v").select("event_id", "v")


@query(
    """WITH ips AS (SELECT c_custkey, 167772160 + c_custkey * 977 AS ip FROM customer), nets AS (SELECT n_nationkey, 167772160 + n_nationkey * 65536 AS low, 167772160 + n_nationkey * 65536 + 32767 AS high FROM nation)
SELECT c_custkey, n_nationkey FROM ips JOIN nets ON ip BETWEEN low AND high"""
)
def ip_range_join(t):
    octet = lambda x, shift: F.pmod(F.shiftright(x, shift), F.lit(256)).cast("string")
    n = F.lit(167772160).cast("long") + F.col("c_custkey") * 977
    ips = t.customer.select("c_custkey", F.concat_ws(".", octet(n, 24), octet(n, 16), octet(n, 8), octet(n, 0)).alias("addr"))
    ips = ips.withColumn("ip", joins.ip_to_long(F.col("addr")))
    nets = t.nation.select("n_nationkey", joins.cidr_range(F.concat(F.lit("10."), F.col("n_nationkey").cast("string"), F.lit(".0.0/17"))).alias("r")).select("n_nationkey", "r.*")
    return joins.range_join(ips, "ip", nets, "low", "high", 65536).select("c_custkey", "n_nationkey")


@query("SELECT n_nationkey, CAST(167772160 + n_nationkey * 2 AS BIGINT) AS first, CAST(167772161 + n_nationkey * 2 AS BIGINT) AS second FROM nation")
def slash31_addresses(t):
    pair = joins.cidr_pair(F.concat(F.lit("10.0.0."), (F.col("n_nationkey") * 2).cast("string"), F.lit("/31")))
    return t.nation.select("n_nationkey", pair[0].alias("first"), pair[1].alias("second"))


@query("SELECT link_pk, bucket_ts FROM (SELECT user_id AS link_pk, ts AS bucket_ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n <= 3")
def top_n_per_group(t):
    rows = t.events.select(F.col("user_id").alias("link_pk"), F.col("ts").alias("bucket_ts"))
    return joins.latest_rows(rows, "link_pk", [F.col("bucket_ts").desc()], 3)


@query("SELECT link_pk FROM links WHERE side_a = 3 OR side_z = 3")
def either_side_filter(t):
    return t.links.filter(joins.either_side("side_a", "side_z", 3)).select("link_pk")


@query(
    """WITH nets AS (SELECT n_nationkey, 167772160 + n_nationkey * 8192 AS base, 20 AS len FROM nation UNION ALL SELECT n_nationkey + 100, 167772160 + n_nationkey * 8192 + 1024, 22 FROM nation UNION ALL SELECT 999, 167772160, 8),
ips AS (SELECT DISTINCT 167772160 + user_id * 977 AS ip FROM events UNION SELECT 167772160 + c_custkey * 331 FROM customer)
SELECT ip, arg_max(n_nationkey, len) AS place, max(len) AS length FROM ips JOIN nets ON ip >> (32 - len) = base >> (32 - len) GROUP BY ip"""
)
def geoip_longest_prefix(t):
    base = F.lit(167772160).cast("long")
    said = lambda n: F.concat_ws(".", *[(F.shiftright(n, k) % 256).cast("string") for k in (24, 16, 8, 0)])
    key = F.col("n_nationkey")
    nets = [
        t.nation.select(F.concat(said(base + key * 8192), F.lit("/20")).alias("network"), key.cast("int").alias("place"), F.lit(20).alias("length")),
        t.nation.select(F.concat(said(base + key * 8192 + 1024), F.lit("/22")).alias("network"), (key + 100).cast("int").alias("place"), F.lit(22).alias("length")),
        t.region.limit(1).select(F.lit("10.0.0.0/8").alias("network"), F.lit(999).alias("place"), F.lit(8).alias("length")),
    ]
    users, gossip = t.events.select(said(base + F.col("user_id") * 977).alias("ip")), t.customer.select(said(base + F.col("c_custkey") * 331).alias("ip"))
    found = geo.longest_prefix(geo.addresses([users, gossip]), nets[0].unionByName(nets[1]).unionByName(nets[2]))
    return found.select(joins.ip_to_long(F.col("ip")).alias("ip"), "place", "length")


SKETCH = """WITH v AS (SELECT link_pk, date_trunc('day', event_ts) AS day, CAST(round(rtt_us * 1000) AS BIGINT) AS v FROM latency WHERE NOT loss AND rtt_us > 0),
low AS (SELECT link_pk, day, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS low FROM v)
"""


@query(SKETCH + "SELECT link_pk, count(*) AS n, quantile_disc(low, 0.5) / 1000.0::DOUBLE AS p50, quantile_disc(low, 0.9375) / 1000.0::DOUBLE AS p94 FROM low GROUP BY link_pk")
def rtt_sketch_by_link(t):
    """Daily sketches of round trips, merged over all days."""
    good = t.latency.filter("NOT loss AND rtt_us > 0").withColumn("day", F.date_trunc("day", "event_ts"))
    daily = sketches.sketch(good, ["link_pk", "day"], F.col("rtt_us"), scale=1000.0)
    return sketches.quantiles(daily, ["link_pk"], {"p50": 0.5, "p94": 0.9375}, scale=1000.0)


@query(SKETCH + "SELECT day, count(*) AS n, quantile_disc(low, 0.5) / 1000.0::DOUBLE AS p50, quantile_disc(low, 0.9375) / 1000.0::DOUBLE AS p94 FROM low GROUP BY day")
def rtt_sketch_by_day(t):
    """The same sketches, merged over all links."""
    good = t.latency.filter("NOT loss AND rtt_us > 0").withColumn("day", F.date_trunc("day", "event_ts"))
    daily = sketches.sketch(good, ["link_pk", "day"], F.col("rtt_us"), scale=1000.0)
    return sketches.quantiles(daily, ["day"], {"p50": 0.5, "p94": 0.9375}, scale=1000.0)
