"""Queries on traffic; line items are interface counters, in buckets of months."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import traffic
from .base import query

R3 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
RATES = ("in_bps", "out_bps", "peak_in_bps", "peak_out_bps")
RATE_SQL = "sum(in_octets) * 8 / sum(seconds) AS in_bps, sum(out_octets) * 8 / sum(seconds) AS out_bps, max(in_octets * 8 / seconds) AS peak_in_bps, max(out_octets * 8 / seconds) AS peak_out_bps"
ROUND_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in RATES)


@query(f"SELECT device_pk, intf, {ROUND_SQL} FROM (SELECT device_pk, intf, {RATE_SQL} FROM counters GROUP BY ALL)")
def rate_mean_peak(t):
    return R3(traffic.interface_rates(t.counters, ["device_pk", "intf"]), *RATES)


@query("SELECT device_pk, round(sum(i), 6) AS in_bps, round(sum(o), 6) AS out_bps FROM (SELECT device_pk, intf, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o FROM counters GROUP BY ALL) GROUP BY device_pk")
def sum_of_rates(t):
    return R3(traffic.sum_of_rates(t.counters, ["device_pk"]), "in_bps", "out_bps")


@query("SELECT round(sum(i), 2) AS in_bps, round(sum(o), 2) AS out_bps, count(*) AS n_interfaces FROM (SELECT sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o FROM counters GROUP BY device_pk, intf)")
def total_throughput(t):
    return traffic.total_throughput(t.counters).withColumns({c: F.round(c, 2) for c in ("in_bps", "out_bps")})


def _bandwidth(t):
    return t.part.select(F.col("p_partkey").alias("link_pk"), (F.col("p_retailprice") * 1000).alias("bandwidth_bps"))


def _dims(t):
    return t.devices.join(t.metros.select("metro_pk", "region_pk"), "metro_pk").select("device_pk", "region_pk")


@query(
    """WITH per AS (SELECT device_pk, intf, link_pk, date_trunc('quarter', event_ts) AS bucket, max(in_octets * 8 / seconds) AS i, max(out_octets * 8 / seconds) AS o FROM counters GROUP BY ALL),
used AS (SELECT bucket, m.region_pk, i * 100 / (p_retailprice * 1000) AS i, o * 100 / (p_retailprice * 1000) AS o FROM per JOIN part ON p_partkey = link_pk JOIN devices d USING (device_pk) JOIN metros m ON m.metro_pk = d.metro_pk)
SELECT bucket, region_pk, round(quantile_cont(i, 0.5), 6) AS p50_in, round(quantile_cont(i, 0.95), 6) AS p95_in, round(max(i), 6) AS max_in, round(quantile_cont(o, 0.5), 6) AS p50_out, round(quantile_cont(o, 0.95), 6) AS p95_out, round(max(o), 6) AS max_out,
  count(*) FILTER (i >= 15 OR o >= 15) AS n_stressed, count(*) AS n FROM used GROUP BY ALL"""
)
def traffic_stress(t):
    rows = traffic.stress(t.counters, _bandwidth(t), _dims(t), group="region_pk", bucket="quarter", threshold=15.0)
    return R3(rows, "p50_in", "p95_in", "max_in", "p50_out", "p95_out", "max_out")


BUSY = "WITH busy AS (SELECT device_pk, intf, date_trunc('month', event_ts) AS bucket, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o, greatest(i, o) AS bps FROM counters GROUP BY device_pk, intf, bucket)\n"


@query(BUSY + "SELECT device_pk, intf, round(max(bps), 6) AS max_bps, round(avg(bps), 6) AS avg_bps, round(quantile_cont(bps, 0.95), 6) AS p95_bps FROM busy GROUP BY ALL ORDER BY avg(bps) DESC, device_pk, intf LIMIT 20")
def traffic_top(t):
    return R3(traffic.top(t.counters, ["device_pk", "intf"], bucket="month", k=20, metric="avg_bps"), "max_bps", "avg_bps", "p95_bps")


@query(f"SELECT intf, bucket, {ROUND_SQL} FROM (SELECT intf, date_trunc('month', event_ts) AS bucket, {RATE_SQL} FROM counters WHERE device_pk = 3 GROUP BY ALL)")
def traffic_drilldown(t):
    return R3(traffic.interface_rates(t.counters.filter("device_pk = 3"), ["intf"], "month"), *RATES)


@query(
    BUSY
    + """, found AS (SELECT device_pk, intf, quantile_cont(bps, 0.5) AS p50_bps, quantile_cont(bps, 0.99) AS p99_bps, count(*) FILTER (bps >= 60000) * 100.0::DOUBLE / count(*) AS stressed_pct,
  arg_max(CASE WHEN i >= o THEN 'in' ELSE 'out' END, (bps, bucket)) AS peak_direction FROM busy GROUP BY ALL)
SELECT device_pk, intf, round(p50_bps, 6) AS p50_bps, round(p99_bps, 6) AS p99_bps, round(stressed_pct, 6) AS stressed_pct, peak_direction, round(p99_bps / p50_bps - 1, 6) AS burstiness FROM found WHERE p99_bps >= 50000"""
)
def traffic_burstiness(t):
    rows = traffic.burstiness(t.counters, ["device_pk", "intf"], bucket="month", threshold_bps=60000.0, least_bps=50000.0)
    return R3(rows, "p50_bps", "p99_bps", "stressed_pct", "burstiness")


@query(
    """SELECT device_pk, intf, CAST(e AS BIGINT) AS errors, CAST(f AS BIGINT) AS fcs, CAST(d AS BIGINT) AS discards, CAST(c AS BIGINT) AS carrier, CAST(e + f + d + c AS BIGINT) AS total
FROM (SELECT device_pk, intf, sum(greatest(errors, 0)) AS e, sum(greatest(fcs, 0)) AS f, sum(greatest(discards, 0)) AS d, sum(greatest(carrier, 0)) AS c FROM counters GROUP BY ALL) WHERE e + f + d + c > 0 ORDER BY e + f + d + c DESC, device_pk, intf LIMIT 50"""
)
def interface_health_rank(t):
    return traffic.health_rank(t.counters, ["device_pk", "intf"], 50)


@query(
    """WITH s AS (SELECT device_pk, intf, link_pk, CAST(sum(greatest(errors, 0)) AS BIGINT) AS errors, CAST(sum(greatest(fcs, 0)) AS BIGINT) AS fcs, CAST(sum(greatest(discards, 0)) AS BIGINT) AS discards, CAST(sum(greatest(carrier, 0)) AS BIGINT) AS carrier,
  min(event_ts) FILTER (greatest(errors, fcs, discards, carrier) > 0) AS first_seen, max(event_ts) FILTER (greatest(errors, fcs, discards, carrier) > 0) AS last_seen FROM counters WHERE event_ts >= TIMESTAMP '1997-01-01' GROUP BY ALL)
SELECT s.*, d.code AS device, l.code AS link FROM s LEFT JOIN devices d USING (device_pk) LEFT JOIN links l USING (link_pk) WHERE greatest(errors, fcs, discards, carrier) > 0"""
)
def interface_issues(t):
    return traffic.interface_issues(t.counters, t.devices, t.links, start=F.to_timestamp(F.lit("1997-01-01")))


@query(
    """WITH per AS (SELECT device_pk, intf, link_pk, date_trunc('quarter', event_ts) AS bucket, max(in_packets / seconds) AS i, max(out_packets / seconds) AS o FROM counters GROUP BY ALL),
used AS (SELECT bucket, m.region_pk, i, o FROM per JOIN devices d USING (device_pk) JOIN metros m ON m.metro_pk = d.metro_pk)
SELECT bucket, region_pk, round(quantile_cont(i, 0.5), 6) AS p50_in, round(quantile_cont(i, 0.95), 6) AS p95_in, round(max(i), 6) AS max_in, round(quantile_cont(o, 0.5), 6) AS p50_out, round(quantile_cont(o, 0.95), 6) AS p95_out, round(max(o), 6) AS max_out,
  count(*) FILTER (i >= 40 OR o >= 40) AS n_stressed, count(*) AS n FROM used GROUP BY ALL"""
)
def traffic_stress_packets(t):
    rows = traffic.stress(t.counters, _bandwidth(t), _dims(t), group="region_pk", bucket="quarter", threshold=40.0, metric="packets")
    return R3(rows, "p50_in", "p95_in", "max_in", "p50_out", "p95_out", "max_out")


ROOM = """WITH busy AS (SELECT device_pk, intf, link_pk, date_trunc('month', event_ts) AS bucket, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o, greatest(i, o) AS bps FROM counters GROUP BY device_pk, intf, link_pk, bucket),
use AS (SELECT b.*, p_retailprice * 1000 AS bandwidth_bps, bps * 100 / (p_retailprice * 1000) AS pct FROM busy b JOIN part ON p_partkey = link_pk)
"""


@query(ROOM + """SELECT device_pk, intf, link_pk, round(max(bps), 6) AS max_bps, round(quantile_cont(pct, 0.95), 6) AS p95_pct, round(any_value(bandwidth_bps), 6) AS bandwidth_bps, round(any_value(bandwidth_bps) - max(bps), 6) AS headroom_bps
FROM use GROUP BY device_pk, intf, link_pk ORDER BY any_value(bandwidth_bps) - max(bps), device_pk, intf, link_pk LIMIT 30""")
def traffic_top_headroom(t):
    return R3(traffic.headroom(t.counters, _bandwidth(t), bucket="month", k=30), "max_bps", "p95_pct", "bandwidth_bps", "headroom_bps")


@query(ROOM + "SELECT * FROM (SELECT device_pk, intf, round(quantile_cont(pct, 0.5), 6) AS p50_pct, round(quantile_cont(pct, 0.99), 6) AS p99_pct, round(quantile_cont(pct, 0.99) - quantile_cont(pct, 0.5), 6) AS spread_pct FROM use GROUP BY device_pk, intf) WHERE spread_pct >= 5")
def traffic_burstiness_use(t):
    return R3(traffic.burstiness_of_use(t.counters, _bandwidth(t), bucket="month", least_pct=5.0), "p50_pct", "p99_pct", "spread_pct")


ITEM = """SELECT kind, bucket, round(sum(i), 6) AS in_bps, round(sum(o), 6) AS out_bps, round(sum(ip), 6) AS in_pps, round(sum(op), 6) AS out_pps FROM (
  SELECT kind, device_pk, intf, date_trunc('month', event_ts) AS bucket, sum(in_octets) / sum(seconds) * 8 AS i, sum(out_octets) / sum(seconds) * 8 AS o, sum(in_packets) / sum(seconds) AS ip, sum(out_packets) / sum(seconds) AS op
  FROM (SELECT 'link' AS kind, * FROM counters WHERE link_pk = 11 UNION ALL SELECT 'device', * FROM counters WHERE device_pk = 3 UNION ALL SELECT 'tunnel', * FROM counters WHERE tunnel_id = 503) GROUP BY ALL) GROUP BY kind, bucket"""


@query(ITEM)
def item_traffic_kinds(t):
    from functools import reduce

    rows = [traffic.item_rates(t.counters, kind, item, "month").withColumn("kind", F.lit(kind)) for kind, item in (("link", 11), ("device", 3), ("tunnel", 503))]
    return R3(reduce(lambda a, b: a.unionByName(b), rows), "in_bps", "out_bps", "in_pps", "out_pps")


@query("SELECT tunnel_id, bucket, round(i, 6) AS out_bps, round(o, 6) AS in_bps, round(ip, 6) AS in_pps, round(op, 6) AS out_pps FROM (SELECT tunnel_id, date_trunc('month', event_ts) AS bucket, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o, sum(in_packets) / sum(seconds) AS ip, sum(out_packets) / sum(seconds) AS op FROM counters GROUP BY ALL)")
def user_traffic_tunnels(t):
    rates = traffic.packet_rates(t.counters, ["tunnel_id"], "month")
    return R3(traffic.perspective(rates, "user"), "in_bps", "out_bps", "in_pps", "out_pps")


@query(f"SELECT device_pk, intf, bucket, {ROUND_SQL}, round(avg(in_bps) OVER w, 6) AS mean_in_bps, round(avg(out_bps) OVER w, 6) AS mean_out_bps FROM (SELECT device_pk, intf, date_trunc('quarter', event_ts) AS bucket, {RATE_SQL} FROM counters GROUP BY ALL) WINDOW w AS (PARTITION BY device_pk, intf)")
def traffic_series(t):
    return R3(traffic.series(t.counters, ["device_pk", "intf"], bucket="quarter"), *RATES, "mean_in_bps", "mean_out_bps")


@query("SELECT * FROM (SELECT *, CAST(sum(discards) OVER (PARTITION BY device_pk, intf) AS BIGINT) AS total FROM (SELECT device_pk, intf, date_trunc('month', event_ts) AS bucket, CAST(sum(greatest(discards, 0)) AS BIGINT) AS discards FROM counters GROUP BY ALL)) WHERE total > 0")
def discard_series(t):
    return traffic.discards(t.counters, bucket="month")


@query(f"SELECT bucket, {ROUND_SQL} FROM (SELECT date_trunc('month', event_ts) AS bucket, {RATE_SQL} FROM counters WHERE link_pk = 11 GROUP BY ALL)")
def item_traffic(t):
    return R3(traffic.interface_rates(t.counters.filter("link_pk = 11").withColumn("one", F.lit(1)), ["one"], "month").drop("one"), *RATES)


@query("SELECT device_pk, bucket, round(i, 6) AS out_bps, round(o, 6) AS in_bps FROM (SELECT device_pk, date_trunc('year', event_ts) AS bucket, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o FROM counters GROUP BY ALL)")
def user_traffic(t):
    rates = traffic.interface_rates(t.counters, ["device_pk"], "year").select("device_pk", "bucket", "in_bps", "out_bps")
    return R3(traffic.perspective(rates, "user"), "in_bps", "out_bps")


LISTS = """WITH users AS (SELECT side_a AS metro_pk, count(*) AS n_users FROM links GROUP BY ALL), rates AS (SELECT device_pk, sum(i) AS bps FROM (SELECT device_pk, intf, sum(in_octets) * 8 / sum(seconds) AS i FROM counters GROUP BY ALL) GROUP BY ALL)
"""


@query(LISTS + "SELECT d.device_pk, d.code, m.code AS metro, d.status, coalesce(u.n_users, 0) AS n_users, round(r.bps, 6) AS in_bps FROM devices d JOIN metros m USING (metro_pk) LEFT JOIN users u USING (metro_pk) LEFT JOIN rates r USING (device_pk)")
def devices_list(t):
    users = t.links.groupBy(F.col("side_a").alias("metro_pk")).agg(F.count("*").alias("n_users"))
    rates = traffic.sum_of_rates(t.counters, ["device_pk"]).select("device_pk", F.round("in_bps", 6).alias("in_bps"))
    rows = t.devices.join(t.metros.select("metro_pk", F.col("code").alias("metro")), "metro_pk").join(users, "metro_pk", "left").join(rates, "device_pk", "left")
    return rows.select("device_pk", "code", "metro", "status", F.coalesce("n_users", F.lit(0)).alias("n_users"), "in_bps")


@query("SELECT m.metro_pk, m.code, count(DISTINCT d.device_pk) AS n_devices, count(DISTINCT l.link_pk) AS n_links FROM metros m LEFT JOIN devices d USING (metro_pk) LEFT JOIN links l ON l.side_a = m.metro_pk GROUP BY ALL")
def metros_list(t):
    devices = t.devices.groupBy("metro_pk").agg(F.count("*").alias("n_devices"))
    links = t.links.groupBy(F.col("side_a").alias("metro_pk")).agg(F.count("*").alias("n_links"))
    rows = t.metros.join(devices, "metro_pk", "left").join(links, "metro_pk", "left")
    return rows.select("metro_pk", "code", F.coalesce("n_devices", F.lit(0)).alias("n_devices"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("SELECT contributor_pk, max(n_devices) AS n_devices, max(n_links) AS n_links FROM (SELECT contributor_pk, count(*) AS n_devices, 0 AS n_links FROM devices GROUP BY 1 UNION ALL SELECT contributor_pk, 0, count(*) FROM links GROUP BY 1) GROUP BY 1")
def contributors_list(t):
    devices = t.devices.groupBy("contributor_pk").agg(F.count("*").alias("n_devices"))
    links = t.links.groupBy("contributor_pk").agg(F.count("*").alias("n_links"))
    return devices.join(links, "contributor_pk", "full").select("contributor_pk", F.coalesce("n_devices", F.lit(0)).alias("n_devices"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("SELECT c_custkey AS user_pk, c_name AS code, n_name AS metro, c_mktsegment AS kind, count(o_orderkey) AS n_sessions FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def users_list(t):
    sessions = t.orders.groupBy(F.col("o_custkey").alias("user_pk")).agg(F.count("*").alias("n_sessions"))
    users = t.customer.select(F.col("c_custkey").alias("user_pk"), F.col("c_name").alias("code"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("kind"))
    rows = users.join(t.nation.select("n_nationkey", F.col("n_name").alias("metro")), "n_nationkey").join(sessions, "user_pk", "left")
    return rows.select("user_pk", "code", "metro", "kind", F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"))


@query(
    """WITH stats AS (SELECT link_pk, round(avg(rtt_us) FILTER (rtt_us > 0), 6) AS avg_rtt_us, count(*) AS n FROM latency GROUP BY ALL)
SELECT 'link' AS kind, l.link_pk AS pk, a.code AS a, z.code AS z, s.avg_rtt_us AS value, coalesce(s.n, 0) AS n FROM links l JOIN metros a ON a.metro_pk = l.side_a JOIN metros z ON z.metro_pk = l.side_z LEFT JOIN stats s USING (link_pk)
UNION ALL SELECT 'device', device_pk, m.code, NULL, CAST(max_users AS DOUBLE), 1 FROM devices JOIN metros m USING (metro_pk)
UNION ALL SELECT 'metro', metro_pk, code, NULL, NULL, 1 FROM metros
UNION ALL SELECT 'validator', node, code, NULL, stake, 1 FROM validators JOIN metros USING (metro_pk) WHERE stake > 0
UNION ALL SELECT 'user', user_pk, CAST(arg_max(device_pk, ("at", version)) AS VARCHAR), NULL, NULL, count(*) FROM user_versions GROUP BY user_pk"""
)
def topology_snapshot(t):
    stats = t.latency.groupBy("link_pk").agg(F.round(F.avg(F.when(F.col("rtt_us") > 0, F.col("rtt_us"))), 6).alias("value"), F.count("*").alias("n"))
    code = lambda k, n: t.metros.select(F.col("metro_pk").alias(k), F.col("code").alias(n))
    links = t.links.select("link_pk", "side_a", "side_z").join(code("side_a", "a"), "side_a").join(code("side_z", "z"), "side_z").join(stats, "link_pk", "left")
    users = t.user_versions.groupBy("user_pk").agg(F.max_by("device_pk", F.struct("at", "version")).cast("string").alias("a"), F.count("*").alias("n"))
    none = F.lit(None)
    one = F.lit(1).cast("long").alias("n")
    return (
        links.select(F.lit("link").alias("kind"), F.col("link_pk").alias("pk"), "a", "z", "value", F.coalesce("n", F.lit(0)).alias("n"))
        .unionByName(t.devices.join(code("metro_pk", "a"), "metro_pk").select(F.lit("device").alias("kind"), F.col("device_pk").alias("pk"), "a", none.cast("string").alias("z"), F.col("max_users").cast("double").alias("value"), one))
        .unionByName(t.metros.select(F.lit("metro").alias("kind"), F.col("metro_pk").cast("long").alias("pk"), F.col("code").alias("a"), none.cast("string").alias("z"), none.cast("double").alias("value"), one))
        .unionByName(t.validators.filter("stake > 0").join(code("metro_pk", "a"), "metro_pk").select(F.lit("validator").alias("kind"), F.col("node").alias("pk"), "a", none.cast("string").alias("z"), F.col("stake").alias("value"), one))
        .unionByName(users.select(F.lit("user").alias("kind"), F.col("user_pk").alias("pk"), "a", none.cast("string").alias("z"), none.cast("double").alias("value"), "n"))
    )


MEMBERS = """WITH said AS (SELECT DISTINCT event_type AS group_pk, user_id AS user_pk, CASE WHEN event_id % 3 = 0 THEN 'P' ELSE 'S' END AS m FROM events),
members AS (SELECT group_pk, user_pk, string_agg(m, '+' ORDER BY m) AS mode FROM said GROUP BY ALL)
"""


def _members(t):
    mine = lambda cond: F.collect_set(F.when(cond, F.col("event_type")))  # noqa: E731; groups of a user, a handful
    users = t.events.groupBy(F.col("user_id").alias("user_pk")).agg(mine(F.col("event_id") % 3 == 0).alias("publishers"), mine(F.col("event_id") % 3 != 0).alias("subscribers"))
    return traffic.group_members(users)


@query(MEMBERS + "SELECT * FROM members")
def multicast_members(t):
    return _members(t)


@query(MEMBERS + "SELECT group_pk, count(*) FILTER (mode LIKE '%P%') AS n_publishers, count(*) FILTER (mode LIKE '%S%') AS n_subscribers, count(*) AS n_members FROM members GROUP BY ALL")
def multicast_counts(t):
    return traffic.group_counts(_members(t))


@query(MEMBERS + "SELECT m.group_pk, m.mode, count(*) OVER (PARTITION BY m.user_pk) AS n_groups FROM members m WHERE m.user_pk = 7")
def user_multicast_groups(t):
    from pyspark.sql import Window

    mine = _members(t).filter("user_pk = 7")
    return mine.select("group_pk", "mode", F.count("*").over(Window.partitionBy("user_pk")).alias("n_groups"))


@query(
    MEMBERS
    + """, tunnels AS (SELECT user_id AS user_pk, user_id % 40 + 1 AS device_pk, CAST(user_id % 7 + 1 AS VARCHAR) AS intf FROM events GROUP BY ALL),
used AS (SELECT device_pk, intf, date_trunc('year', event_ts) AS bucket, avg(in_octets * 8 / seconds) AS bps FROM counters GROUP BY ALL)
SELECT group_pk, mode, bucket, round(sum(bps), 6) AS bps FROM members JOIN tunnels USING (user_pk) JOIN used USING (device_pk, intf) GROUP BY ALL"""
)
def multicast_traffic(t):
    tunnels = t.events.select(F.col("user_id").alias("user_pk"), (F.col("user_id") % 40 + 1).alias("device_pk"), (F.col("user_id") % 7 + 1).cast("string").alias("intf")).distinct()
    return traffic.group_traffic(_members(t), tunnels, t.counters, bucket="year").withColumn("bps", F.round("bps", 6))


@query("SELECT l_linenumber % 3 AS k, CASE l_linenumber % 3 WHEN 0 THEN 'tunnel' WHEN 1 THEN 'link' ELSE 'other' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL")
def intf_type_filter(t):
    k = F.col("l_linenumber") % 3
    named = F.when(k == 0, "Tunnel5").when(k == 1, "Ethernet2/1").otherwise("Loopback0")
    return t.lineitem.select(k.alias("k"), traffic.interface_kind(named).alias("kind")).groupBy("k", "kind").agg(F.count("*").alias("n"))


@query(
    """SELECT m.metro_pk, m.code, m.region_pk, (SELECT count(*) FROM devices d WHERE d.metro_pk = m.metro_pk) AS n_devices, (SELECT count(*) FROM links l WHERE l.side_a = m.metro_pk OR l.side_z = m.metro_pk) AS n_links,
  (SELECT count(*) FROM validators v WHERE v.metro_pk = m.metro_pk AND v.stake > 0) AS n_validators, (SELECT round(coalesce(sum(v.stake), 0), 4) FROM validators v WHERE v.metro_pk = m.metro_pk) AS stake FROM metros m WHERE m.metro_pk = 3"""
)
def metro_detail(t):
    return traffic.metro_detail(t.metros.filter("metro_pk = 3"), t.devices, t.links, t.validators).withColumn("stake", F.round("stake", 4))


@query(
    """SELECT 2 AS contributor_pk, (SELECT count(*) FROM devices WHERE contributor_pk = 2) AS n_devices, count(*) AS n_links, count(*) FILTER (status <> 'activated') AS n_drained, sum(bandwidth_bps) AS bandwidth_bps,
  (SELECT round(sum(bps), 6) FROM (SELECT sum(in_octets) * 8 / sum(seconds) AS bps FROM counters JOIN devices USING (device_pk) WHERE contributor_pk = 2 GROUP BY device_pk, intf)) AS in_bps FROM links WHERE contributor_pk = 2"""
)
def contributor_detail(t):
    return traffic.contributor_detail(2, t.devices, t.links, t.counters).withColumn("in_bps", F.round("in_bps", 6))


@query(
    """SELECT v.node AS user_pk, v.vote_pubkey AS code, v.kind, m.code AS metro, v.stake, count(o_orderkey) AS n_sessions, min(o_orderdate) AS first_session, max(o_orderdate) AS last_session, arg_max(o_orderstatus = 'O', (o_orderdate, o_orderkey)) AS is_connected
FROM validators v JOIN metros m USING (metro_pk) LEFT JOIN orders ON o_custkey = v.node WHERE v.node = 77 GROUP BY ALL"""
)
def user_detail(t):
    users = t.validators.filter("node = 77").join(t.metros.select("metro_pk", F.col("code").alias("metro")), "metro_pk")
    users = users.select(F.col("node").alias("user_pk"), F.col("vote_pubkey").alias("code"), "kind", "metro", "stake")
    sessions = t.orders.select(F.col("o_custkey").alias("user_pk"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "O").alias("is_connected"))
    return traffic.user_detail(users, sessions)
