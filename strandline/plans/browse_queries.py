"""Queries of browsing: filters, search, pages, catalog and nested sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import filters as f
from ..sources import catalog as c
from ..sources import records, tables
from .base import TABLES, query


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100 OFFSET 50")
def paginate(t):
    return f.page(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], offset=50)


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 100")
def sort_by(t):
    order = f.sort_by("size", "desc", {"size": "p_size", "name": "p_name"}, "name")
    return f.page(t.part.select("p_partkey", "p_size"), [order, "p_partkey"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def filter_text(t):
    return t.part.filter(f.contains(["p_name", "p_type"], "RING")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000 AND o_totalprice < 450000")
def filter_numeric(t):
    price = F.col("o_totalprice")
    return t.orders.filter(f.numeric(price, ">=400k") & f.numeric(price, "< 0.45m")).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'error')")
def filter_boolean(t):
    return t.events.filter(f.boolean(F.col("event_type") == "error", "No")).select("event_id")


@query(
    """WITH hits AS (SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS pk, p_name AS label FROM part WHERE contains(lower(p_name || ' ' || p_brand), '1') AND contains(lower(p_name), 'red')
  UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), '1') AND contains(lower(s_name), 'red')
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE contains(lower(c_name || c_mktsegment), '1') AND contains(lower(c_name), 'red'))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY label, pk) AS n, count(*) OVER (PARTITION BY kind) AS total FROM hits) WHERE n <= 10"""
)
def search_entities(t):
    kinds = [("part", t.part, "p_partkey", "p_name", ["p_name", "p_brand"]), ("supplier", t.supplier, "s_suppkey", "s_name", ["s_name"]), ("customer", t.customer, "c_custkey", "c_name", ["c_name", "c_mktsegment"])]
    return f.search(kinds, "red 1", 10)


@query(
    """WITH hits AS (SELECT 'link' AS kind, CAST(link_pk AS VARCHAR) AS pk, code AS label FROM links WHERE contains(lower(code || ' ' || status || ' ' || link_type), '1')
  UNION ALL SELECT 'device', CAST(device_pk AS VARCHAR), code FROM devices WHERE contains(lower(code), '1') UNION ALL SELECT 'metro', CAST(metro_pk AS VARCHAR), code FROM metros WHERE contains(lower(code), '1')
  UNION ALL SELECT 'validator', CAST(node AS VARCHAR), vote_pubkey FROM validators WHERE stake > 0 AND contains(lower(vote_pubkey), '1') UNION ALL SELECT 'gossip', CAST(node AS VARCHAR), vote_pubkey FROM validators WHERE contains(lower(vote_pubkey), '1')
  UNION ALL SELECT 'contributor', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), '1') UNION ALL SELECT 'user', CAST(user_pk AS VARCHAR), 'user ' || user_pk FROM (SELECT DISTINCT user_pk, address FROM user_versions) WHERE contains('user ' || user_pk || ' ' || address, '1')
  UNION ALL SELECT 'multicast_group', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), '1'))
SELECT kind, pk, label, n, total FROM (SELECT h.*, row_number() OVER (PARTITION BY h.kind ORDER BY CASE WHEN h.kind = 'validator' THEN v.stake ELSE 0 END DESC, label, pk) AS n, count(*) OVER (PARTITION BY h.kind) AS total
  FROM hits h LEFT JOIN validators v ON h.kind = 'validator' AND CAST(v.node AS VARCHAR) = h.pk) WHERE n <= 10"""
)
def search_network(t):
    staked = t.validators.filter("stake > 0")
    kinds = [("link", t.links, "link_pk", "code", ["code", "status", "link_type"]), ("device", t.devices, "device_pk", "code", ["code"]), ("metro", t.metros, "metro_pk", "code", ["code"])]
    kinds += [("validator", staked, "node", "vote_pubkey", ["vote_pubkey"]), ("gossip", t.validators, "node", "vote_pubkey", ["vote_pubkey"]), ("contributor", t.supplier, "s_suppkey", "s_name", ["s_name"])]
    users = t.user_versions.select("user_pk", "address").distinct().withColumn("label", F.concat(F.lit("user "), F.col("user_pk").cast("string")))
    kinds += [("user", users, "user_pk", "label", ["label", "address"]), ("multicast_group", t.part, "p_partkey", "p_name", ["p_name", "p_brand"])]
    return f.search(kinds, "1", 10, order={"validator": "stake"})


@query("SELECT DISTINCT p_brand AS value FROM part WHERE p_size > 20 ORDER BY 1 LIMIT 100")
def field_values(t):
    return f.field_values(t.part, "p_brand", F.col("p_size") > 20)


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k(t):
    return t.events.select("event_id", "value").orderBy(F.col("value").desc(), "event_id").limit(25)


@query("SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' GROUP BY 1")
def time_range_bucket(t):
    from datetime import datetime

    start, end, _ = f.time_range("7d", now=datetime(2024, 1, 10))
    at = lambda d: F.to_timestamp(F.lit(d.isoformat(sep=" ")))
    rows = t.events.filter((F.col("ts") >= at(start)) & (F.col("ts") < at(end)))
    return rows.groupBy(F.window("ts", "3600 seconds")["start"].alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN ('NATION_1', 'NATION_2') AND l_returnflag = 'A'")
def dimension_filters(t):
    devices = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("metro"))
    rows = f.dimensions(t.lineitem, {"metro": "NATION_1,NATION_2", "l_returnflag": "A", "kind": ""}, {"metro": (devices, "l_suppkey")})
    return rows.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 100.0 GROUP BY 1")
def query_sql(t):
    return c.run_sql(t.spark, " SELECT event_type, count(*) AS n FROM {e} WHERE value > 100.0 GROUP BY 1 ;", e=t.events)


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 250.0 AND user_id < 50 GROUP BY 1")
def query_params(t):
    return c.run_sql(t.spark, "SELECT event_type, count(*) AS n FROM {e} WHERE value > :least AND user_id < :most GROUP BY 1", {"least": 250.0, "most": 50}, e=t.events)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(epoch_us(ts) % 1000000 / 1000) AS INT) AS VARCHAR), 3, '0') || 'Z' AS ts FROM events")
def json_safe_rows(t):
    odd = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return c.json_safe(t.events.select("event_id", odd.alias("v"), "ts"))


@query("SELECT table_name, column_name, ordinal_position AS position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'pages')")
def catalog(t):
    return c.catalog({name: getattr(t, name) for name in TABLES}, t.spark).select("table_name", "column_name", "position")


@query(
    """SELECT column_name, array_to_string(list_sort(list(DISTINCT v)), ',') AS samples FROM (SELECT 'l_returnflag' AS column_name, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem) GROUP BY 1"""
)
def categorical_samples(t):
    return c.categorical_samples(t.lineitem).withColumn("samples", F.array_join("samples", ","))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, 443 + page_id % 5 AS port FROM pages")
def host_port_split(t):
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    pair = tables.host_port(F.concat(host, F.lit(":"), (443 + F.col("page_id") % 5).cast("string")))
    return t.pages.select("page_id", pair["host"].alias("host"), pair["port"].cast("long").alias("port"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') > 0 AS is_delinquent, max(event_id) AS credits_epoch, max(event_id) * 2 AS credits FROM events GROUP BY 1")
def vote_activity_rows(t):
    lists = t.events.groupBy("user_id").agg(F.to_json(F.array(F.max(F.array("event_id", F.col("event_id") * 2)))).alias("epoch_credits"), (F.count_if(F.col("event_type") == "error") > 0).alias("bad"))
    rows = records.vote_rows(lists.filter("NOT bad").drop("bad"), lists.filter("bad").drop("bad"), F.lit(7))
    return rows.select("user_id", "is_delinquent", "credits_epoch", "credits")


@query("SELECT o_custkey AS identity, count(*) AS slots, count(*) FILTER (o_orderstatus <> 'F') AS blocks, CAST(o_custkey % 3 AS BIGINT) AS epoch FROM orders GROUP BY ALL")
def block_production_rows(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("s"), F.count_if(F.col("o_orderstatus") != "F").alias("b"))
    maps = n.select((F.col("o_custkey") % 3).alias("epoch"), F.create_map("o_custkey", F.array("s", "b")).alias("by_identity"))
    return records.production_rows(maps)


LSDB = "SELECT CAST(src AS VARCHAR) AS system_id, 'host' || src AS hostname, CAST(dst AS VARCHAR) AS neighbor_id, metric, '10.0.' || src || '.' || dst AS neighbor_addr FROM edges"


@query(LSDB)
def lsdb_flatten(t):
    e = t.edges
    one = F.struct(F.col("dst").cast("string").alias("systemId"), "metric", F.concat_ws(".", F.lit("10.0"), "src", "dst").alias("neighborAddr"))
    lsps = e.groupBy("src").agg(F.collect_list(one).alias("neighbors"))
    lsp = F.struct(F.struct(F.concat(F.lit("host"), "src").alias("name")).alias("hostname"), "neighbors")
    entry = lsps.select(F.create_map(F.col("src").cast("string"), lsp).alias("lsps"))
    nest = F.struct(F.create_map(F.lit("default"), F.struct(F.create_map(F.lit("1"), F.struct(F.create_map(F.lit("2"), F.struct("lsps")).alias("level"))).alias("isisInstances"))).alias("vrfs"))
    rows = records.flatten_lsdb(entry.select(F.to_json(nest).alias("dump")))
    return rows.select("system_id", "hostname", "neighbor_id", "metric", "neighbor_addr")


@query("SELECT l.link_pk, CASE WHEN l.side_a % 2 = 0 THEN 'a' || l.side_a END AS side_a_ip, CASE WHEN l.side_z % 2 = 0 THEN 'a' || l.side_z END AS side_z_ip FROM links l")
def link_interface_ip_enrich(t):
    listed = F.to_json(F.array(F.struct(F.lit("eth0").alias("name"), F.concat(F.lit("a"), "metro_pk").alias("ip"))))
    devices = t.metros.filter("metro_pk % 2 = 0").select(F.col("metro_pk").alias("device_pk"), listed.alias("interfaces"))
    links = t.links.select("link_pk", F.col("side_a").alias("side_a_pk"), F.lit("eth0").alias("side_a_iface"), F.col("side_z").alias("side_z_pk"), F.lit("eth0").alias("side_z_iface"))
    return records.interface_ips(links, devices).select("link_pk", "side_a_ip", "side_z_ip")


@query("SELECT o_custkey AS node, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS slots, count(*) AS slot_count FROM orders GROUP BY 1")
def leader_schedule_rows(t):
    rows = t.orders.groupBy(F.col("o_custkey").alias("node")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("slots")).withColumn("epoch", F.lit(1))
    return records.leader_rows(rows).select("node", "slots", "slot_count")


@query("SELECT DISTINCT 167772160 + user_id * 977 AS ip_long, n_nationkey FROM events JOIN nation ON 167772160 + user_id * 977 BETWEEN 167772160 + n_nationkey * 8192 AND 167772160 + n_nationkey * 8192 + 4095")
def geoip_enrich(t):
    base = F.lit(167772160).cast("long")
    ips = t.events.select((base + F.col("user_id") * 977).alias("ip_long"))
    ranges = t.nation.select("n_nationkey", (base + F.col("n_nationkey") * 8192).alias("low"), (base + F.col("n_nationkey") * 8192 + 4095).alias("high"))
    return records.located(ips, ranges, 8192).select("ip_long", "n_nationkey")


@query("SELECT DISTINCT CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE '10.' || o_custkey % 200 END AS ip FROM orders WHERE o_custkey % 4 <> 0")
def distinct_gossip_ips(t):
    from ..operators.scd2 import latest

    nodes = latest(t.history).select(F.when(F.col("entity_id").cast("int") % 4 != 0, F.concat(F.lit("10."), F.col("entity_id").cast("int") % 200)).otherwise(F.lit("")).alias("ip"))
    return nodes.filter("ip <> ''").distinct()


@query("SELECT 'orders' AS feed, CAST(o_custkey AS VARCHAR) AS entity, o_orderdate AS ts FROM orders UNION ALL SELECT 'events', CAST(user_id AS VARCHAR), ts FROM events UNION ALL SELECT 'lineitem', CAST(l_suppkey AS VARCHAR), l_shipdate FROM lineitem")
def feed_union(t):
    one = lambda df, name, entity, at: df.select(F.lit(name).alias("feed"), F.col(entity).cast("string").alias("entity"), F.col(at).alias("ts"))
    return reduce(lambda a, b: a.unionByName(b), [one(t.orders, "orders", "o_custkey", "o_orderdate"), one(t.events, "events", "user_id", "ts"), one(t.lineitem, "lineitem", "l_suppkey", "l_shipdate")])
