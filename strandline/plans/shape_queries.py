"""Queries for the plain shapes of joins, aggregates, windows, sets and scalar functions, and the lists that combine them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.filters import page
from ..operators import facts, geo, lists, outages, scd2, traffic
from ..sources import snapshots, tables
from .base import query, ts

# Joins


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_star(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def join_left(t):
    n = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) b ON a.k = b.k")
def join_full(t):
    a = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = t.customer.filter("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full")


@query("SELECT s_suppkey, round(s_acctbal * 100 / (SELECT sum(s_acctbal) FROM supplier), 9) AS share FROM supplier")
def join_scalar(t):
    total = t.supplier.agg(F.sum("s_acctbal").alias("total"))
    return t.supplier.crossJoin(F.broadcast(total)).select("s_suppkey", F.round(F.col("s_acctbal") * 100 / F.col("total"), 9).alias("share"))  # one row


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def join_semi(t):
    return t.customer.join(t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def join_anti(t):
    return t.customer.join(t.events.select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT user_id, event_id FROM events WHERE (user_id, ts) IN (SELECT user_id, max(ts) FROM events GROUP BY 1)")
def join_latest_tuple(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@query("SELECT count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity = 50) b USING (l_suppkey, l_linenumber)")
def join_multi_key(t):
    keys = t.lineitem.filter("l_quantity = 50").select("l_suppkey", "l_linenumber").distinct()
    return t.lineitem.join(keys, ["l_suppkey", "l_linenumber"]).agg(F.count("*").alias("n"))


@query("SELECT e.user_id, count(*) AS n FROM (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'signup' GROUP BY 1) s JOIN events e ON e.user_id = s.user_id AND e.ts > s.first AND e.event_type = 'purchase' GROUP BY 1")
def join_inequality(t):
    first = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first"))
    return t.events.filter("event_type = 'purchase'").join(first, "user_id").filter("ts > first").groupBy("user_id").agg(F.count("*").alias("n"))


# Aggregates


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q, round(avg(l_discount), 9) AS d, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_hash(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.round(F.avg("l_discount"), 9).alias("d"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, round(avg(value) FILTER (event_type = 'view'), 6) AS views, round(quantile_cont(value, 0.95) FILTER (event_type = 'click'), 6) AS p95 FROM events GROUP BY 1")
def agg_conditional(t):
    when = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg(when("view")), 6).alias("views"), F.round(F.percentile(when("click"), F.lit(0.95)), 6).alias("p95"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def agg_quantiles(t):
    return t.events.groupBy("event_type").agg(*[F.round(F.percentile("value", F.lit(q / 100)), 6).alias(f"p{q}") for q in (50, 95, 99)])


@query("SELECT user_id, arg_max(event_type, (value, event_id)) AS top, arg_min(event_type, (value, event_id)) AS low FROM events GROUP BY 1")
def agg_arg_extremum(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", "event_id")).alias("top"), F.min_by("event_type", F.struct("value", "event_id")).alias("low"))


@query("SELECT c_nationkey, min(n_name) AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def agg_any_value(t):
    rows = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("c_nationkey").agg(F.min("n_name").alias("name"), F.count("*").alias("n"))


@query("SELECT user_id, max(n) AS busiest_day FROM (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def agg_two_level(t):
    days = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))
    return days.groupBy("user_id").agg(F.max("n").alias("busiest_day"))


@query("SELECT day, n, n - lag(n) OVER (ORDER BY day) AS change FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)")
def agg_lag(t):
    days = t.events.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("day")))


@query("SELECT least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(*) >= 5")
def agg_pairs_having(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.least("s_nationkey", "c_nationkey").alias("a"), F.greatest("s_nationkey", "c_nationkey").alias("b")).agg(F.count("*").alias("n")).filter("n >= 5")


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def agg_weighted_mean(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(numbers.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 9).alias("mean"))


@query("SELECT device_pk, CAST(sum(greatest(carrier, 0)) AS BIGINT) AS carrier FROM counters GROUP BY 1")
def agg_clamped_sum(t):
    return t.counters.groupBy("device_pk").agg(numbers.clamped_sum(F.col("carrier")).alias("carrier"))


@query("SELECT o_custkey, round((max(n) - max(ok)) * 100.0::DOUBLE / max(n), 6) AS skip_pct FROM (SELECT o_custkey, count(*) OVER w AS n, count(*) FILTER (o_orderstatus <> 'F') OVER w AS ok FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) GROUP BY 1")
def agg_skip_rate(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select("o_custkey", F.count("*").over(w).alias("n"), F.count_if(F.col("o_orderstatus") != "F").over(w).alias("ok"))
    return rows.groupBy("o_custkey").agg(F.round(numbers.ratio((F.max("n") - F.max("ok")) * 100.0, F.max("n")), 6).alias("skip_pct"))


# Windows


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders")
def window_row_number_lag(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("n"), F.lag("o_orderstatus").over(w).alias("previous"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events")
def window_forward_fill(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS later FROM events")
def window_running_sum(t):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.round(F.coalesce(F.sum("value").over(w), F.lit(0.0)), 4).alias("later"))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS edge FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(edge) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, run"""
)
def window_islands(t):
    rows = outages.islands(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type"))
    return rows.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n")).drop("island")


@query("SELECT event_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS micros FROM events")
def window_gap_to_next(t):
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    return t.events.select("event_id", (F.unix_micros(following) - F.unix_micros("ts")).alias("micros"))


# Sets and scalars


@query("SELECT user_id AS k FROM events EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def set_difference(t):
    past = t.customer.filter("c_nationkey < 12").select(F.col("c_custkey").alias("k"))
    return t.events.select(F.col("user_id").alias("k")).distinct().join(past, "k", "left_anti")


@query("SELECT user_id AS k FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 12")
def set_intersection(t):
    return t.events.select(F.col("user_id").alias("k")).intersect(t.customer.filter("c_nationkey < 12").select("c_custkey"))


@query("SELECT DISTINCT event_type, user_id % 7 AS g FROM events")
def set_distinct(t):
    return t.events.select("event_type", (F.col("user_id") % 7).alias("g")).distinct()


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, strlen(p_name) AS n, contains(lower(p_type), 'eco') AS eco, p_name ILIKE 'RED%' AS red, substr(p_brand, 7) AS brand FROM part")
def scalar_strings(t):
    return t.part.select(
        "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.octet_length("p_name").cast("long").alias("n"), F.contains(F.lower("p_type"), F.lit("eco")).alias("eco"),
        F.ilike("p_name", F.lit("RED%")).alias("red"), F.substring("p_brand", 7, 100).alias("brand"),
    )


@query("SELECT event_id, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day, strftime(ts, '%Y%m') AS month, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, ts + INTERVAL 90 MINUTE AS later FROM events")
def scalar_times(t):
    return t.events.select(
        "event_id", F.date_trunc("hour", "ts").alias("hour"), F.to_date("ts").alias("day"), F.date_format("ts", "yyyyMM").alias("month"), F.unix_seconds("ts").alias("seconds"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("later")
    )


@query("SELECT event_id, greatest(value, 100) AS hi, least(value, 100) AS lo, abs(value - 100) AS d, round(value) AS r, nullif(event_type, 'error') AS ok, CAST(floor(value) AS BIGINT) AS f FROM events")
def scalar_numbers(t):
    v = F.col("value")
    return t.events.select("event_id", F.greatest(v, F.lit(100.0)).alias("hi"), F.least(v, F.lit(100.0)).alias("lo"), F.abs(v - 100).alias("d"), F.round(v).alias("r"), F.nullif(F.col("event_type"), F.lit("error")).alias("ok"), F.floor(v).alias("f"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, i AS position, [event_type, 'x'][i] AS tag FROM events, range(1, 3) r(i)")
def scalar_json_arrays(t):
    tags = F.posexplode(F.array("event_type", F.lit("x")))
    rows = t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), tags.alias("position", "tag"))
    return rows.withColumn("position", (F.col("position") + 1).cast("long"))


# Lists and sums that combine them


LINKS = """WITH lat AS (SELECT link_pk, avg(rtt_us) FILTER (rtt_us > 0) AS r, avg(rtt_us) FILTER (rtt_us > 0 AND direction = 0) AS az, avg(rtt_us) FILTER (rtt_us > 0 AND direction = 1) AS za, count(*) FILTER (loss) * 100.0::DOUBLE / count(*) AS loss, count(*) AS n
  FROM latency WHERE event_ts <= TIMESTAMP '2024-01-20' GROUP BY 1),
rates AS (SELECT link_pk, sum(in_octets) * 8 / sum(seconds) AS i, sum(out_octets) * 8 / sum(seconds) AS o FROM counters GROUP BY 1),
rows AS (SELECT l.link_pk, l.code, a.code AS a, z.code AS z, l.status, round(r, 6) AS avg_rtt_us, round(az, 6) AS a_to_z_us, round(za, 6) AS z_to_a_us, round(loss, 6) AS loss_pct, coalesce(n, 0) AS n_samples, round(i * 100 / bandwidth_bps, 6) AS in_pct,
  round(o * 100 / bandwidth_bps, 6) AS out_pct FROM links l JOIN metros a ON a.metro_pk = side_a JOIN metros z ON z.metro_pk = side_z LEFT JOIN lat USING (link_pk) LEFT JOIN rates USING (link_pk))
"""


def _links(t):
    rows = lists.links(t.links, t.latency, traffic.interface_rates(t.counters, ["link_pk"]), t.metros, as_of=ts("2024-01-20"))
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_rtt_us", "a_to_z_us", "z_to_a_us", "loss_pct", "in_pct", "out_pct")})


@query(LINKS + "SELECT * FROM rows")
def links_list(t):
    return _links(t)


@query(LINKS + "SELECT * FROM rows ORDER BY loss_pct DESC NULLS LAST, link_pk LIMIT 20 OFFSET 20")
def links_page(t):
    return page(_links(t), [F.col("loss_pct").desc_nulls_last(), "link_pk"], 20, 20)


@query("SELECT l.link_pk, l.code, l.committed_rtt_us, count(s.sample_index) AS n_samples, min(s.rtt_us) FILTER (s.rtt_us > 0) AS min_rtt_us FROM links l LEFT JOIN latency s USING (link_pk) WHERE l.link_pk = 12 GROUP BY ALL")
def link_detail(t):
    stats = t.latency.filter("link_pk = 12").groupBy("link_pk").agg(F.count("*").alias("n_samples"), F.min(F.when(F.col("rtt_us") > 0, F.col("rtt_us"))).alias("min_rtt_us"))
    rows = t.links.filter("link_pk = 12").join(stats, "link_pk", "left")
    return rows.select("link_pk", "code", "committed_rtt_us", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "min_rtt_us")


@query("SELECT d.device_pk, d.code, d.max_users, count(*) AS n_rows, CAST(sum(greatest(errors, 0)) AS BIGINT) AS errors FROM devices d JOIN counters c USING (device_pk) WHERE d.device_pk = 9 GROUP BY ALL")
def device_detail(t):
    stats = t.counters.filter("device_pk = 9").groupBy("device_pk").agg(F.count("*").alias("n_rows"), numbers.clamped_sum(F.col("errors")).alias("errors"))
    return t.devices.filter("device_pk = 9").join(stats, "device_pk").select("device_pk", "code", "max_users", "n_rows", "errors")


NODES = """WITH nodes AS (SELECT c_custkey AS node, '10.' || (c_custkey % 250) || '.' || (c_custkey % 7) || '.9' AS address, c_custkey % 250 AS net FROM customer), held AS (SELECT node, sum(stake) AS stake FROM validators GROUP BY node),
live AS (SELECT DISTINCT user_pk AS node FROM user_versions WHERE status = 'activated' AND "at" >= TIMESTAMP '2001-01-01'),
rows AS (SELECT n.node, n.address, coalesce(h.stake, 0) AS stake, coalesce(h.stake, 0) > 0 AS is_validator, l.node IS NOT NULL AS is_on, m.n_name AS place FROM nodes n LEFT JOIN held h USING (node) LEFT JOIN live l USING (node) LEFT JOIN nation m ON m.n_nationkey * 9 = n.net)
"""


def _nodes(t):
    key = F.col("c_custkey")
    nodes = t.customer.select(key.alias("node"), F.concat(F.lit("10."), key % 250, F.lit("."), key % 7, F.lit(".9")).alias("address"))
    networks = t.nation.select(F.concat(F.lit("10."), F.col("n_nationkey") * 9, F.lit(".0.0/16")).alias("network"), F.col("n_name").alias("place"))
    live = t.user_versions.filter((F.col("status") == "activated") & (F.col("at") >= ts("2001-01-01"))).select(F.col("user_pk").alias("node"))
    places = geo.longest_prefix(geo.addresses([nodes.select(F.col("address").alias("ip"))]), networks).drop("network")
    return lists.gossip_nodes(nodes, t.validators.select("node", "stake"), live, places)


@query(NODES + "SELECT * FROM rows ORDER BY stake DESC, node LIMIT 100")
def gossip_nodes_list(t):
    return page(_nodes(t), [F.col("stake").desc(), "node"], 100)


@query(NODES + "SELECT * FROM rows WHERE node = 36")
def gossip_node_detail(t):
    return _nodes(t).filter("node = 36")


@query(
    """WITH live AS (SELECT DISTINCT user_pk FROM user_versions WHERE status = 'activated' AND "at" >= TIMESTAMP '2001-01-01'), users AS (SELECT user_pk, arg_max(status, ("at", version)) AS status FROM user_versions GROUP BY 1),
tunnels AS (SELECT sum(in_octets) * 8 / sum(seconds) AS bps FROM counters GROUP BY device_pk, tunnel_id)
SELECT (SELECT count(*) FROM links WHERE status = 'activated') AS n_links, (SELECT count(*) FROM devices) AS n_devices, (SELECT count(*) FROM metros) AS n_metros, (SELECT count(DISTINCT contributor_pk) FROM links) AS n_contributors,
  (SELECT sum(bandwidth_bps) FROM links) AS bandwidth_bps, (SELECT count(*) FROM validators WHERE stake > 0) AS n_validators, (SELECT count(*) FROM users WHERE status = 'activated') AS n_users, (SELECT round(avg(bps), 4) FROM tunnels) AS user_bps,
  (SELECT round(sum(stake), 4) FROM validators WHERE node IN (SELECT user_pk FROM live)) AS on_stake, (SELECT round(sum(CASE WHEN node IN (SELECT user_pk FROM live) THEN stake ELSE 0 END) * 100 / sum(stake), 6) FROM validators) AS stake_share_pct"""
)
def summary_stats(t):
    live = t.user_versions.filter((F.col("status") == "activated") & (F.col("at") >= ts("2001-01-01"))).select(F.col("user_pk").alias("node"), F.lit(True).alias("is_on")).distinct()
    stakes = t.validators.select("node", "stake").join(live, "node", "left")
    users = t.user_versions.groupBy("user_pk").agg(F.max_by("status", F.struct("at", "version")).alias("status"))
    rows = lists.summary(t.links, t.devices, t.metros, stakes, users, traffic.interface_rates(t.counters, ["device_pk", "tunnel_id"]))
    return rows.withColumns({"user_bps": F.round("user_bps", 4), "on_stake": F.round("on_stake", 4), "stake_share_pct": F.round("stake_share_pct", 6)})


@query(
    """WITH first AS (SELECT o_custkey, min(o_orderdate) AS joined FROM orders GROUP BY 1)
SELECT date_trunc('month', joined) AS bucket, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY date_trunc('month', joined)) AS BIGINT) AS total FROM first GROUP BY 1"""
)
def growth_history(t):
    months = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("joined")).groupBy(F.date_trunc("month", "joined").alias("bucket")).agg(F.count("*").alias("n"))
    return months.withColumn("total", F.sum("n").over(Window.orderBy("bucket")))


@query("SELECT c_custkey, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '') AS name FROM customer")
def read_table_blank_is_null(t):
    import uuid

    from ..sources.shared import shared_dir

    path = f"{shared_dir(t.spark)}/table-{uuid.uuid4().hex}"
    t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name")).write.parquet(path)
    return tables.read_table(t.spark, path, "c_custkey long, name string")


@query("SELECT link_pk, sample_index, rtt_us FROM latency WHERE event_ts >= TIMESTAMP '2024-01-05' AND event_ts < TIMESTAMP '2024-01-20'")
def backfill_range(t):
    import uuid

    from ..sources.shared import shared_dir

    path = f"{shared_dir(t.spark)}/facts-{uuid.uuid4().hex}"
    rows = lambda df: df.select("event_ts", "link_pk", "sample_index", "rtt_us")
    wrong = lambda df: rows(df).withColumn("rtt_us", F.lit(-1.0))
    facts.backfill(wrong, t.latency, ts("2024-01-08"), ts("2024-01-20"), path)
    for a, b in (("2024-01-05", "2024-01-12"), ("2024-01-12", "2024-01-20")):  # two chunks
        facts.backfill(rows, t.latency, ts(a), ts(b), path)
    return t.spark.read.parquet(path).select("link_pk", "sample_index", "rtt_us")


@query("SELECT event_ts, link_pk, sample_index FROM latency WHERE event_ts < TIMESTAMP '2024-01-10'")
def fact_append(t):
    import uuid

    from ..sources.shared import shared_dir

    path = f"{shared_dir(t.spark)}/facts-{uuid.uuid4().hex}"
    rows = t.latency.select("event_ts", "link_pk", "sample_index")
    facts.append(rows.filter(F.col("event_ts") < ts("2024-01-05")), path, rows)
    facts.append(rows.filter((F.col("event_ts") >= ts("2024-01-05")) & (F.col("event_ts") < ts("2024-01-10"))), path, rows)
    return t.spark.read.parquet(path).drop("month")


@query(
    """SELECT 'contributors' AS kind, CAST(r_regionkey AS VARCHAR) AS entity_id, r_name AS code, NULL AS status, NULL AS place FROM region
UNION ALL SELECT 'devices', CAST(device_pk AS VARCHAR), code, status, CAST(metro_pk AS VARCHAR) FROM devices
UNION ALL SELECT 'users', CAST(user_pk AS VARCHAR), NULL, arg_max(status, ("at", version)), CAST(arg_max(device_pk, ("at", version)) AS VARCHAR) FROM user_versions GROUP BY user_pk
UNION ALL SELECT 'metros', CAST(metro_pk AS VARCHAR), code, NULL, NULL FROM metros
UNION ALL SELECT 'links', CAST(link_pk AS VARCHAR), code, status, CASE WHEN link_pk % 3 <> 0 THEN '10.' || side_a || '.' || (link_pk % 200) || '.1' END FROM links
UNION ALL SELECT 'multicast_groups', CAST(p_partkey AS VARCHAR), p_name, CASE p_size % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'activated' WHEN 2 THEN 'suspended' WHEN 3 THEN 'deleted' ELSE 'unknown' END, NULL FROM part"""
)
def snapshot_entities(t):
    """All six kinds; links get the address of the interface at their first side, where it has one."""
    side = F.concat(F.lit("if"), F.col("link_pk").cast("string"))
    ends = t.links.select(F.col("link_pk").alias("pk"), "status", "code", F.col("side_a").alias("side_a_pk"), F.col("side_z").alias("side_z_pk"), side.alias("side_a_iface"), side.alias("side_z_iface"))
    interfaces = t.links.filter("link_pk % 3 <> 0").select(F.col("side_a").alias("device_pk"), side.alias("intf"), F.concat(F.lit("10."), "side_a", F.lit("."), F.col("link_pk") % 200, F.lit(".1/31")).alias("ip"))
    newest = F.struct("at", "version")
    sources = {
        "contributors": t.region.select(F.col("r_regionkey").alias("pk"), F.col("r_name").alias("code")),
        "devices": t.devices.withColumnRenamed("device_pk", "pk"),
        "users": t.user_versions.groupBy(F.col("user_pk").alias("pk")).agg(F.max_by("status", newest).alias("status"), F.max_by("device_pk", newest).alias("device_pk")),
        "metros": t.metros.withColumnRenamed("metro_pk", "pk"),
        "links": snapshots.with_addresses(ends, interfaces),
        "multicast_groups": t.part.select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("code"), (F.col("p_size") % 6).alias("status")),
    }
    places = {"devices": "metro_pk", "users": "device_pk", "links": "side_a_ip"}
    out = None
    for kind, df in snapshots.snapshots(sources).items():
        pick = lambda c, df=df: F.col(c) if c in df.columns else F.lit(None).cast("string")
        rows = df.select(F.lit(kind).alias("kind"), "entity_id", pick("code").alias("code"), pick("status").alias("status"), pick(places.get(kind, "")).alias("place"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT entity_id, count(*) AS n_versions FROM history GROUP BY 1 HAVING count(*) >= 10")
def current_with_many_versions(t):
    n = t.history.groupBy("entity_id").agg(F.count("*").alias("n_versions")).filter("n_versions >= 10")
    return scd2.latest(t.history, "entity_id").join(n, "entity_id").select("entity_id", "n_versions")
