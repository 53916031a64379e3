"""Queries on validators and stake. Customers are validators and orders their connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validators as v
from ..sources.shared import durable
from .base import query, ts

ON = """WITH active AS (SELECT o_custkey AS node, max(o_orderdate) AS connected_ts FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1),
on_net AS (SELECT x.node, x.stake, x.metro_pk, x.kind, a.connected_ts, m.code FROM validators x JOIN active a USING (node) JOIN metros m USING (metro_pk) WHERE x.stake > 0)
"""


def _users(t):
    rows = t.orders.filter(F.col("o_orderdate") >= ts("2001-01-01"))
    status = F.when(F.col("o_orderstatus") == "O", "activated").otherwise("drained")
    return rows.select(F.col("o_custkey").alias("node"), F.col("o_orderdate").alias("connected_ts"), status.alias("status"))


def _on(t):
    return v.on_net(_users(t), t.validators, t.metros.select("metro_pk", "code"))


SPANS = """WITH u AS (SELECT user_pk, address, device_pk, status, is_deleted, "at" AS s, lead("at") OVER (PARTITION BY user_pk ORDER BY "at", version) AS e FROM user_versions),
g AS (SELECT node, address, is_deleted, "at" AS s, lead("at") OVER (PARTITION BY node ORDER BY "at", version) AS e FROM gossip_versions),
v AS (SELECT vote_pubkey, node, stake, is_deleted, "at" AS s, lead("at") OVER (PARTITION BY vote_pubkey ORDER BY "at", version) AS e FROM vote_versions),
live_v AS (SELECT * FROM v WHERE NOT is_deleted AND stake > 0 AND (e IS NULL OR e > s)),
spans AS (SELECT v.vote_pubkey, v.node, u.user_pk, u.device_pk, v.stake, greatest(u.s, g.s, v.s) AS s, nullif(least(coalesce(u.e, TIMESTAMP '9999-01-01'), coalesce(g.e, TIMESTAMP '9999-01-01'), coalesce(v.e, TIMESTAMP '9999-01-01')), TIMESTAMP '9999-01-01') AS e
  FROM u JOIN g USING (address) JOIN live_v v ON g.node = v.node
  WHERE u.status = 'activated' AND NOT u.is_deleted AND NOT g.is_deleted AND greatest(u.s, g.s, v.s) < least(coalesce(u.e, TIMESTAMP '9999-01-01'), coalesce(g.e, TIMESTAMP '9999-01-01'), coalesce(v.e, TIMESTAMP '9999-01-01'))),
connected AS (SELECT vote_pubkey, node, max(s) AS connected_ts, max(stake) AS stake, count(DISTINCT user_pk) AS n_users FROM spans WHERE s <= TIMESTAMP '1997-06-01' AND (e IS NULL OR e > TIMESTAMP '1997-06-01') GROUP BY ALL),
reach AS (SELECT vote_pubkey, s, coalesce(e, TIMESTAMP '9999-01-01') AS e, max(coalesce(e, TIMESTAMP '9999-01-01')) OVER (PARTITION BY vote_pubkey ORDER BY s, coalesce(e, TIMESTAMP '9999-01-01') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM spans),
numbered AS (SELECT *, sum(CASE WHEN upto >= s THEN 0 ELSE 1 END) OVER (PARTITION BY vote_pubkey ORDER BY s, e) AS run FROM reach),
runs AS (SELECT vote_pubkey, min(s) AS s, nullif(max(e), TIMESTAMP '9999-01-01') AS e FROM numbered GROUP BY vote_pubkey, run),
own AS (SELECT r.vote_pubkey, v.stake, greatest(r.s, v.s) AS s, CASE WHEN r.e IS NULL THEN v.e WHEN v.e IS NULL THEN r.e ELSE least(r.e, v.e) END AS e FROM runs r JOIN live_v v USING (vote_pubkey)
  WHERE r.s < coalesce(v.e, TIMESTAMP '9999-01-01') AND v.s < coalesce(r.e, TIMESTAMP '9999-01-01'))
"""


def _spans(t, **asked):
    return v.connected_spans(t.user_versions, t.gossip_versions, t.vote_versions, **asked)


@query(SPANS + "SELECT * FROM connected")
def validators_on_net(t):
    return v.connected_at(_spans(t, at=[ts("1997-06-01")]), ts("1997-06-01"))


@query(ON + "SELECT x.node, x.stake, m.code AS metro FROM validators x JOIN metros m USING (metro_pk) WHERE stake > 0 AND node NOT IN (SELECT node FROM on_net)")
def validators_off_net(t):
    return v.off_net(t.validators, _on(t)).join(t.metros, "metro_pk").select("node", "stake", F.col("code").alias("metro"))


def _history(t):
    status = F.when(F.col("o_orderstatus") == "O", "activated").otherwise("drained")
    return t.orders.select(F.col("o_custkey").alias("node"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("version"), status.alias("status"), F.col("o_orderpriority").alias("kind"))


FIRST = "WITH first AS (SELECT o_custkey AS node, min(o_orderdate) AS first_connected, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS kind, count(*) AS n_connections FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)\n"


@query(SPANS + "SELECT vote_pubkey, node, min(s) AS first_connected, count(*) AS n_connections, arg_max(user_pk, (s, user_pk)) AS user_pk, arg_max(device_pk, (s, user_pk)) AS device_pk, arg_max(stake, (s, user_pk)) AS stake FROM spans GROUP BY ALL")
def validator_connections(t):
    return v.first_connections(_spans(t))


def _first(t):
    """Each customer's first connection, for the views that carry users by node."""
    active = _history(t).filter("status = 'activated'")
    return active.groupBy("node").agg(F.min("at").alias("first_connected"), F.count("*").alias("n_connections"))


@query(FIRST + ", " + ON[5:] + "SELECT n.node, n.stake, f.first_connected, f.n_connections FROM on_net n JOIN first f USING (node)")
def validator_new_connections(t):
    return _on(t).select("node", "stake").join(_first(t), "node")


@query(
    SPANS
    + """SELECT vote_pubkey, node, max(e) AS disconnected, arg_max(s, (e, s, user_pk)) AS connected_ts, arg_max(user_pk, (e, s, user_pk)) AS user_pk FROM spans
WHERE e <= TIMESTAMP '1997-06-01' AND vote_pubkey NOT IN (SELECT vote_pubkey FROM connected) GROUP BY ALL"""
)
def validator_disconnections(t):
    return v.disconnections(_spans(t, until=ts("1997-06-01")), ts("1997-06-01"))


@query(SPANS + "SELECT vote_pubkey, CAST(vote_pubkey AS BIGINT) AS node, s AS \"at\", 'joined' AS event FROM runs UNION ALL SELECT vote_pubkey, CAST(vote_pubkey AS BIGINT), e, 'left' FROM runs WHERE e IS NOT NULL")
def validator_join_leave_events(t):
    return v.join_leave_events(_spans(t))


PERF = ON + """, votes AS (SELECT user_id AS node, avg(CASE WHEN event_type <> 'error' THEN value END) AS avg_lag, min(CASE WHEN event_type <> 'error' THEN value END) AS min_lag, max(CASE WHEN event_type <> 'error' THEN value END) AS max_lag,
  arg_max(event_type = 'error', (ts, event_id)) AS is_delinquent FROM events GROUP BY 1),
slots AS (SELECT o_custkey AS node, count(*) * 2 AS assigned, count(*) FILTER (o_orderstatus <> 'F') * 2 AS produced FROM orders GROUP BY 1),
perf AS (SELECT votes.*, (assigned - produced) * 100.0::DOUBLE / assigned AS skip_pct, CASE WHEN o.node IS NULL THEN 'off-net' ELSE 'on-net' END AS network FROM votes LEFT JOIN slots USING (node) LEFT JOIN on_net o USING (node))
"""


def _performance(t):
    activity = t.events.select(F.col("user_id").alias("node"), F.col("ts").alias("event_ts"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("is_delinquent"), F.col("value").alias("cluster_slot"), F.lit(0.0).alias("last_vote_slot"))
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    production = t.orders.select(F.col("o_custkey").alias("node"), (F.row_number().over(w) * 2).alias("assigned"), (F.count_if(F.col("o_orderstatus") != "F").over(w) * 2).alias("produced"))
    return v.performance(activity, production, _on(t))


@query(PERF + "SELECT node, round(avg_lag, 6) AS avg_lag, min_lag, max_lag, is_delinquent, round(skip_pct, 6) AS skip_pct, network FROM perf")
def validator_performance(t):
    return _performance(t).withColumns({c: F.round(c, 6) for c in ("avg_lag", "skip_pct")})


@query(PERF + "SELECT network, count(*) AS n, round(avg(avg_lag), 6) AS avg_lag, round(avg(skip_pct), 6) AS avg_skip_pct, count(*) FILTER (is_delinquent) AS n_delinquent FROM perf GROUP BY 1")
def performance_by_status(t):
    return v.by_network(_performance(t)).withColumns({c: F.round(c, 6) for c in ("avg_lag", "avg_skip_pct")})


@query(ON + "SELECT node, stake, is_on, round(stake * 100 / sum(stake) OVER (), 9) AS share_pct FROM (SELECT v.node, v.stake, o.node IS NOT NULL AS is_on FROM validators v LEFT JOIN on_net o USING (node) WHERE v.stake > 0) ORDER BY stake DESC, node LIMIT 50")
def stake_validators(t):
    return v.ranked(t.validators, _on(t), limit=50).select("node", "stake", "is_on", F.round("share_pct", 9).alias("share_pct"))


PROFILE = PERF + """, rates AS (SELECT link_pk AS node, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o FROM counters GROUP BY 1),
profile AS (SELECT x.node, x.stake, round(x.stake * 100 / (SELECT sum(stake) FROM validators), 9) AS share_pct, o.node IS NOT NULL AS is_on, round(p.avg_lag, 6) AS avg_lag, round(p.skip_pct, 6) AS skip_pct, p.is_delinquent, round(i, 6) AS in_bps, round(r.o, 6) AS out_bps
  FROM validators x LEFT JOIN on_net o USING (node) LEFT JOIN perf p USING (node) LEFT JOIN rates r USING (node) WHERE x.stake > 0)
"""


def _profile(t):
    from ..operators import lists, traffic

    rates = traffic.interface_rates(t.counters, ["link_pk"]).withColumnRenamed("link_pk", "node")
    rows = lists.validators(v.ranked(t.validators, _on(t)).select("node", "stake", "share_pct", "is_on"), _performance(t), rates)
    return rows.withColumns({"share_pct": F.round("share_pct", 9), **{c: F.round(c, 6) for c in ("avg_lag", "skip_pct", "in_bps", "out_bps")}})


@query(PROFILE + "SELECT * FROM profile WHERE is_on ORDER BY stake DESC, node LIMIT 20 OFFSET 20")
def validators_list(t):
    from ..functions.filters import page

    return page(_profile(t).filter("is_on"), [F.col("stake").desc(), "node"], 20, 20)


@query(PROFILE + "SELECT * FROM profile WHERE node IN (42, 43, 44)")
def validator_profile(t):
    return _profile(t).filter("node IN (42, 43, 44)")


@query(ON + "SELECT v.node, v.vote_pubkey, v.stake, v.node IN (SELECT node FROM on_net) AS is_on, count(o_orderkey) AS n_sessions FROM validators v LEFT JOIN orders ON o_custkey = v.node WHERE v.node = 42 GROUP BY ALL")
def validator_detail(t):
    one = t.validators.filter("node = 42").join(_on(t).select("node", F.lit(True).alias("is_on")), "node", "left")
    n = t.orders.filter("o_custkey = 42").groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("n_sessions"))
    return one.join(n, "node", "left").select("node", "vote_pubkey", "stake", F.coalesce("is_on", F.lit(False)).alias("is_on"), F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"))


SERIES = SPANS + """, instants AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 HOUR)) AS t),
steps AS (SELECT t, on_stake, n_on, total FROM (
  SELECT {place_s} AS t, stake AS on_stake, 1 AS n_on, 0 AS total FROM own UNION ALL SELECT {place_e}, -stake, -1, 0 FROM own WHERE e IS NOT NULL
  UNION ALL SELECT {place_s}, 0, 0, stake FROM live_v UNION ALL SELECT {place_e}, 0, 0, -stake FROM live_v WHERE e IS NOT NULL)),
step_sums AS (SELECT t, sum(CAST(on_stake AS DECIMAL(18,2))) AS o, sum(n_on) AS n, sum(CAST(total AS DECIMAL(18,2))) AS a FROM steps GROUP BY t),
series AS (SELECT t, CAST(sum(coalesce(o, 0)) OVER (ORDER BY t) AS DOUBLE) AS on_stake, CAST(sum(coalesce(a, 0)) OVER (ORDER BY t) AS DOUBLE) AS total_stake, CAST(sum(coalesce(n, 0)) OVER (ORDER BY t) AS BIGINT) AS n_on FROM instants LEFT JOIN step_sums USING (t)),
shared AS (SELECT *, coalesce(on_stake * 100 / nullif(total_stake, 0), 0) AS share_pct FROM series)
""".replace("{place_s}", "greatest(date_trunc('hour', s + INTERVAL 59 MINUTE + INTERVAL 59 SECOND), TIMESTAMP '1992-01-01')").replace("{place_e}", "greatest(date_trunc('hour', e + INTERVAL 59 MINUTE + INTERVAL 59 SECOND), TIMESTAMP '1992-01-01')")


def _series(t, spans, on=None):
    return v.stake_series(spans, t.vote_versions, start=ts("1992-01-01"), end=ts("1998-12-31"), step="1 HOUR", on=on)


@query(SERIES + "SELECT t, on_stake, total_stake, n_on, round(share_pct, 9) AS share_pct FROM shared")
def stake_history(t):
    return _series(t, _spans(t)).withColumn("share_pct", F.round("share_pct", 9))


@query(
    SERIES
    + """SELECT n.on_stake, n.total_stake, round(n.share_pct, 9) AS share_pct, d.on_stake AS on_stake_24h, n.on_stake - d.on_stake AS on_stake_change_24h, d.total_stake AS total_stake_24h, n.total_stake - d.total_stake AS total_stake_change_24h,
  round(d.share_pct, 9) AS share_pct_24h, round(n.share_pct - d.share_pct, 9) AS share_change_24h, w.on_stake AS on_stake_7d, n.on_stake - w.on_stake AS on_stake_change_7d, w.total_stake AS total_stake_7d, n.total_stake - w.total_stake AS total_stake_change_7d,
  round(w.share_pct, 9) AS share_pct_7d, round(n.share_pct - w.share_pct, 9) AS share_change_7d
FROM shared n, shared d, shared w WHERE n.t = TIMESTAMP '1997-06-01' AND d.t = TIMESTAMP '1997-05-31' AND w.t = TIMESTAMP '1997-05-25'"""
)
def stake_overview(t):
    now, ago = ts("1997-06-01"), {"24h": "24 HOURS", "7d": "7 DAYS"}
    spans = _spans(t, at=[now, *(now - F.expr(f"INTERVAL {back}") for back in ago.values())])  # the series is right at these instants
    rows = v.stake_overview(_series(t, spans), now, ago)
    return rows.withColumns({c: F.round(c, 9) for c in rows.columns if "share" in c})


CHANGES_SQL = SPANS + """, b AS (SELECT DISTINCT vote_pubkey, stake FROM own WHERE s <= TIMESTAMP '1996-06-01' AND (e IS NULL OR e > TIMESTAMP '1996-06-01')), a AS (SELECT DISTINCT vote_pubkey, stake FROM own WHERE s <= TIMESTAMP '1997-06-01' AND (e IS NULL OR e > TIMESTAMP '1997-06-01')),
changed AS (SELECT vote_pubkey AS node, stake, 'left' AS change FROM b WHERE vote_pubkey NOT IN (SELECT vote_pubkey FROM a) UNION ALL SELECT vote_pubkey, stake, 'joined' FROM a WHERE vote_pubkey NOT IN (SELECT vote_pubkey FROM b))
"""


def _changes(t):
    times = [ts("1996-06-01"), ts("1997-06-01")]
    on = durable(v.own_stake(_spans(t, at=times)).withColumnRenamed("vote_pubkey", "node"))
    at = lambda when: on.filter((F.col("start") <= ts(when)) & (F.col("end").isNull() | (F.col("end") > ts(when)))).select("node", "stake")
    return v.joined_or_left(at("1996-06-01"), at("1997-06-01"))


@query(CHANGES_SQL + "SELECT * FROM changed")
def stake_changes(t):
    return _changes(t)


@query(CHANGES_SQL + "SELECT change, count(*) AS n, sum(stake) AS stake, max(stake) AS largest FROM changed GROUP BY change")
def stake_changes_summary(t):
    return v.changes_summary(_changes(t))


@query(
    """WITH stakes AS (SELECT user_id AS node, ts AS at, event_id AS version, value AS stake FROM events), l AS (SELECT *, lag(stake) OVER (PARTITION BY node ORDER BY "at", version) AS previous FROM stakes)
SELECT node, "at", version, previous, stake, round(stake - previous, 6) AS change, round(abs(stake - previous) * 100 / nullif(previous, 0), 6) AS change_pct FROM l
WHERE previous IS NOT NULL AND "at" >= TIMESTAMP '2024-01-05' AND "at" < TIMESTAMP '2024-01-25' AND stake <> previous AND (abs(stake - previous) >= 200 OR abs(stake - previous) * 100 / nullif(previous, 0) >= 500)"""
)
def stake_change_events(t):
    return _stake_changes(t)


def _stake_changes(t, of=None):
    events = t.events if of is None else t.events.filter(of("user_id"))
    stakes = events.select(F.col("user_id").alias("node"), F.col("ts").alias("at"), F.col("event_id").alias("version"), F.col("value").alias("stake"))
    rows = v.stake_change_events(stakes, min_abs=200.0, min_pct=500.0, start=ts("2024-01-05"), end=ts("2024-01-25"))
    return rows.withColumns({c: F.round(c, 6) for c in ("change", "change_pct")})


ATTRIBUTION = SERIES + """, own_steps AS (SELECT vote_pubkey, t, sum(x) AS x, sum(n) AS n FROM (
  SELECT vote_pubkey, greatest(date_trunc('hour', s + INTERVAL 59 MINUTE + INTERVAL 59 SECOND), TIMESTAMP '1992-01-01') AS t, stake AS x, 1 AS n FROM own
  UNION ALL SELECT vote_pubkey, greatest(date_trunc('hour', e + INTERVAL 59 MINUTE + INTERVAL 59 SECOND), TIMESTAMP '1992-01-01'), -stake, -1 FROM own WHERE e IS NOT NULL) WHERE t <= TIMESTAMP '1998-12-31' GROUP BY ALL),
run AS (SELECT *, sum(x) OVER w AS after, sum(n) OVER w AS n_after FROM own_steps WINDOW w AS (PARTITION BY vote_pubkey ORDER BY t)),
reasons AS (SELECT vote_pubkey, t, CASE WHEN n_after - n = 0 THEN 'joined' WHEN n_after = 0 THEN 'left' ELSE 'stake_changed' END AS kind, x AS change FROM run WHERE t > TIMESTAMP '1992-01-01' AND (x <> 0 OR (n_after > 0) <> (n_after - n > 0)))
"""


def _moves(on):
    return v.stake_moves(on, start=ts("1992-01-01"), end=ts("1998-12-31"), step="1 HOUR")


def _attribution(t, of=None, **asked):
    """of: a condition on vote accounts, by the name of their column, if not all are asked for."""
    gossip, votes = t.gossip_versions, t.vote_versions
    if of is not None:
        votes = votes.filter(of("vote_pubkey"))
        gossip = gossip.join(votes.select("node").distinct(), "node", "left_semi")
    return v.connected_moves(t.user_versions, gossip, votes, start=ts("1992-01-01"), end=ts("1998-12-31"), step="1 HOUR", **asked)


@query(ATTRIBUTION + "SELECT t, vote_pubkey, kind, change FROM reasons")
def stake_attribution(t):
    return _attribution(t)


@query(
    ATTRIBUTION
    + """, per AS (SELECT t, sum(change) AS change FROM reasons GROUP BY t)
SELECT p.t, p.change, round(n.share_pct - coalesce(sum(p.change) OVER (ORDER BY p.t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100 / n.total_stake, 9) AS share_pct FROM per p, shared n WHERE n.t = TIMESTAMP '1998-12-31'"""
)
def share_walkback(t):
    spans = _spans(t)
    on = durable(v.own_stake(spans))
    now = _series(t, spans, on).filter(F.col("t") == ts("1998-12-31"))
    return v.walkback(_moves(on), now).withColumn("share_pct", F.round("share_pct", 9))


@query(ON + "SELECT m.region_pk, count(*) AS n, round(sum(stake), 4) AS stake FROM on_net o JOIN metros m USING (metro_pk) GROUP BY 1")
def geo_region_counts(t):
    return v.region_counts(_on(t).drop("code"), t.metros.select("metro_pk", "region_pk"), "region_pk").withColumn("stake", F.round("stake", 4))


@query(
    """WITH users AS (SELECT c_custkey, CAST(c_nationkey * 7 - 80 AS DOUBLE) AS user_lat, CAST(c_nationkey * 14 - 170 AS DOUBLE) AS user_lon, CAST(c_custkey % 25 * 7 - 80 AS DOUBLE) AS device_lat, CAST(c_custkey % 25 * 14 - 170 AS DOUBLE) AS device_lon FROM customer),
k AS (SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(device_lat - user_lat) / 2), 2) + cos(radians(user_lat)) * cos(radians(device_lat)) * pow(sin(radians(device_lon - user_lon) / 2), 2))) AS km FROM users)
SELECT c_custkey, round(km, 3) AS km FROM k WHERE km > 5000"""
)
def user_geo_mismatch(t):
    place = lambda c: ((c * 7 - 80).cast("double"), (c * 14 - 170).cast("double"))
    (ua, uo), (da, do) = place(F.col("c_nationkey")), place(F.col("c_custkey") % 25)
    users = t.customer.select("c_custkey", ua.alias("user_lat"), uo.alias("user_lon"), da.alias("device_lat"), do.alias("device_lon"))
    return v.geo_mismatch(users, 5000.0).select("c_custkey", F.round("km", 3).alias("km"))
