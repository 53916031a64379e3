"""Queries on the network graph, made of the largest routes between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources.shared import durable
from .base import query

#: Rounds of the oracles' searches. Paths between 25 nodes have at most 24 hops; with scenarios fewer rounds are made, and a longer path shows as a difference.
ROUNDS, FEW = 24, 9


def _rounds(name: str, begin: str, grow: str, keys: str, n: int, where: str = "") -> str:
    """CTEs that extend the best paths p by one edge a round; the last is called name."""
    out = [f"{name}0 AS MATERIALIZED ({begin})"]
    for k in range(1, n + 1):
        now = name if k == n else f"{name}{k}"
        out.append(f"{now} AS MATERIALIZED (SELECT {keys}, min(p) AS p FROM (SELECT * FROM {name}{k - 1} UNION ALL {grow.format(last=f'{name}{k - 1}')} {where}) GROUP BY ALL)")
    return ",\n".join(out)


G = "WITH g AS MATERIALIZED (SELECT src, dst, metric, bandwidth FROM edges),\n"
OWN = "SELECT n_nationkey::INT AS src, n_nationkey::INT AS dst, (0::BIGINT, 0, [n_nationkey::INT]) AS p FROM nation"
STEP = "SELECT {keys}w.src, e.dst, ({cost}, w.p[2] + 1, list_append(w.p[3], e.dst)) FROM {{last}} w JOIN g e ON e.src = w.dst"
BEST = G + _rounds("best", OWN, STEP.format(keys="", cost="w.p[1] + e.metric"), "src, dst", ROUNDS) + "\n"
HOPS = _rounds("few", OWN, STEP.format(keys="", cost="w.p[1] + 1"), "src, dst", ROUNDS) + "\n"
WIDE = _rounds("wide", OWN.replace("0::BIGINT", "(-4611686018427387904)::BIGINT"), STEP.format(keys="", cost="greatest(w.p[1], -e.bandwidth)"), "src, dst", ROUNDS) + "\n"


def _edges(t):
    return durable(t.edges)


def _nodes(t):
    return t.nation.select(F.col("n_nationkey").alias("src"))


def _text(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


PATH_TEXT = "array_to_string(p[3], '>')"


@query("SELECT node, count(DISTINCT other) AS n FROM (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY node")
def graph_degree(t):
    return graph.degree(t.edges)


@query("SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM edges GROUP BY src")
def adjacency_list(t):
    return graph.adjacency_list(t.edges)


@query("SELECT src, dst, metric, CAST(bandwidth AS BIGINT) AS bandwidth FROM edges")
def links_with_metrics(t):
    return t.edges.select("src", "dst", "metric", F.col("bandwidth").cast("long").alias("bandwidth"))


@query(
    """SELECT 'metro' AS kind, CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b FROM nation UNION ALL SELECT 'device', device_pk, metro_pk FROM devices UNION ALL SELECT 'edge', src, dst FROM edges
UNION ALL SELECT 'link', side_a, side_z FROM links UNION ALL SELECT DISTINCT 'user', user_pk, device_pk FROM user_versions WHERE status = 'activated'"""
)
def build_topology(t):
    from ..operators import lists

    pair = lambda df, a, b: df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    users = t.user_versions.filter("status = 'activated'").select("user_pk", "device_pk").distinct()
    nodes = {"metro": pair(t.nation, "n_nationkey", "n_regionkey"), "device": pair(t.devices, "device_pk", "metro_pk")}
    return lists.topology(nodes, {"edge": pair(t.edges, "src", "dst"), "link": pair(t.links, "side_a", "side_z"), "user": pair(users, "user_pk", "device_pk")})


@query("SELECT a AS src, b AS dst, metric FROM (SELECT src AS a, dst AS b, metric FROM edges WHERE (src + dst) % 6 <> 0 UNION ALL SELECT dst, src, metric FROM edges WHERE (src + dst) % 6 <> 0)")
def build_adjacency(t):
    e = t.edges
    pair = lambda x, y: F.concat_ws(".", F.lit("10"), F.col(x), F.col(y))
    status = F.when((F.col("src") + F.col("dst")) % 6 == 0, "soft-drained").otherwise("activated")
    links = e.select(F.col("src").alias("a_pk"), F.col("dst").alias("z_pk"), F.concat(pair("src", "dst"), F.lit(".0")).alias("a_addr"), F.concat(pair("src", "dst"), F.lit(".1")).alias("z_addr"), status.alias("status"), "bandwidth")
    heard = e.select("src", F.concat(pair("src", "dst"), F.lit(".1")).alias("neighbor_addr"), "metric").unionByName(e.select(F.col("dst").alias("src"), F.concat(pair("src", "dst"), F.lit(".0")).alias("neighbor_addr"), "metric"))
    return graph.adjacency(heard, links).select("src", "dst", "metric")


LIVE = "(SELECT e.* FROM edges e WHERE src IN (SELECT metro_pk FROM devices WHERE status = 'activated') AND dst IN (SELECT metro_pk FROM devices WHERE status = 'activated'))"


@query(G.replace("FROM edges", f"FROM {LIVE}") + HOPS + "SELECT src, dst AS node, p[2] AS hops FROM few WHERE p[2] <= 3")
def reachable(t):
    live = graph.active(t.edges, t.devices.select(F.col("metro_pk").alias("node"), "status"))
    return graph.reachable(durable(live), _nodes(t), 3).select("src", F.col("dst").alias("node"), "hops")


@query(
    """WITH u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), near AS (SELECT c AS center, c AS node FROM (SELECT unnest([3, 8]) AS c) UNION SELECT c, dst FROM (SELECT unnest([3, 8]) AS c) JOIN u ON src = c
  UNION SELECT c, b.dst FROM (SELECT unnest([3, 8]) AS c) JOIN u a ON a.src = c JOIN u b ON b.src = a.dst)
SELECT a.center, e.src, e.dst, e.metric FROM edges e JOIN near a ON a.node = e.src JOIN near b ON b.node = e.dst AND a.center = b.center"""
)
def k_hop_subgraph(t):
    return graph.subgraph(_edges(t), _nodes(t).filter("src IN (3, 8)"), 2)


@query(G + HOPS + "SELECT src, dst, p[2] AS hops FROM few")
def shortest_path_hops(t):
    return graph.best_paths(_edges(t), _nodes(t), cost="hops").select("src", "dst", "hops")


@query(BEST + f"SELECT src, dst, p[1] AS cost, p[2] AS hops, {PATH_TEXT} AS path FROM best")
def shortest_path(t):
    return graph.best_paths(_edges(t), _nodes(t)).select("src", "dst", "cost", "hops", _text("path").alias("path"))


@query(G + WIDE + "SELECT src, dst, -p[1] AS width FROM wide WHERE src <> dst")
def widest_path(t):
    return graph.best_paths(_edges(t), _nodes(t), cost="bottleneck").filter("src <> dst").select("src", "dst", (-F.col("cost")).alias("width"))


FIGURES = """, figures AS (SELECT a, b, sum(s) / sum(n) AS rtt_us, sum(j) / nullif(sum(nj), 0) AS jitter_us, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_samples, sum(bandwidth_bps) AS bandwidth_bps, count(*) FILTER (status <> 'activated') AS n_drained
  FROM (SELECT link_pk, side_a AS a, side_z AS b, bandwidth_bps, status FROM links UNION ALL SELECT link_pk, side_z, side_a, bandwidth_bps, status FROM links) LEFT JOIN
  (SELECT link_pk, sum(rtt_us) AS s, count(*) AS n, sum(ipdv_us) AS j, count(ipdv_us) AS nj FROM jittered WHERE NOT loss AND rtt_us > 0 GROUP BY 1) USING (link_pk) WHERE a <> b GROUP BY a, b),
hops AS (SELECT b.src, b.dst, i - 1 AS hop, p[3][i] AS a, p[3][i + 1] AS b FROM best b, range(1, len(p[3])) r(i))
"""


@query(
    BEST
    + FIGURES
    + """SELECT h.src, h.dst, h.hop, h.a, h.b, g.metric, CAST(sum(g.metric) OVER (PARTITION BY h.src, h.dst ORDER BY h.hop) AS BIGINT) AS running_metric, round(rtt_us, 6) AS rtt_us, round(jitter_us, 6) AS jitter_us, f.bandwidth_bps, coalesce(n_drained, 0) AS n_drained
FROM hops h JOIN g ON g.src = h.a AND g.dst = h.b LEFT JOIN figures f ON f.a = h.a AND f.b = h.b"""
)
def explain_route(t):
    e = _edges(t)
    rows = graph.hops_of(graph.best_paths(e, _nodes(t)), e, ["src", "dst"]).join(graph.link_figures(t.links, t.jittered), ["a", "b"], "left")
    return rows.select(
        "src", "dst", F.col("hop").cast("long").alias("hop"), "a", "b", "metric", "running_metric", F.round("rtt_us", 6).alias("rtt_us"), F.round("jitter_us", 6).alias("jitter_us"),
        "bandwidth_bps", F.coalesce("n_drained", F.lit(0)).alias("n_drained"),
    )


@query()  # SQL would have to list all simple paths; tests compare with that on a small graph
def k_shortest_paths(t):
    pairs = _nodes(t).crossJoin(t.nation.select(F.col("n_nationkey").alias("dst"))).filter("src <> dst")  # the result has rows for each
    rows = graph.ranked_paths(_edges(t), pairs, k=3)
    return rows.select("src", "dst", F.col("n").cast("long").alias("n"), "cost", "hops", _text("path").alias("path"))


@query(BEST + FIGURES + "SELECT src, dst, round(sum(rtt_us), 6) AS rtt_us, min(coalesce(n_samples, 0)) AS min_samples, count(*) AS n_hops, count(rtt_us) AS n_measured FROM hops LEFT JOIN figures USING (a, b) GROUP BY src, dst")
def path_measured_latency(t):
    e = _edges(t)
    hops = graph.hops_of(graph.best_paths(e, _nodes(t)), e, ["src", "dst"]).join(graph.link_figures(t.links, t.jittered), ["a", "b"], "left")
    sums = hops.groupBy("src", "dst").agg(F.sum("rtt_us").alias("rtt_us"), F.min(F.coalesce("n_samples", F.lit(0))).alias("min_samples"), F.count("*").alias("n_hops"), F.count("rtt_us").alias("n_measured"))
    return sums.withColumn("rtt_us", F.round("rtt_us", 6))


@query(
    BEST + ", " + HOPS + ", " + WIDE
    + f""", modes AS (SELECT 'latency' AS mode, src, dst, p FROM best UNION ALL SELECT 'hops', src, dst, p FROM few UNION ALL SELECT 'bandwidth', src, dst, p FROM wide),
ranked AS (SELECT mode, a.n_regionkey AS from_region, b.n_regionkey AS to_region, p, row_number() OVER (PARTITION BY mode, a.n_regionkey, b.n_regionkey ORDER BY p) AS n FROM modes JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey)
SELECT mode, from_region, to_region, CASE WHEN mode = 'bandwidth' THEN -p[1] ELSE p[1] END AS cost, p[2] AS hops, {PATH_TEXT} AS path FROM ranked WHERE n = 1"""
)
def metro_path_modes(t):
    e, n, r = _edges(t), _nodes(t), _regions(t)
    rows = [graph.region_paths(e, n, r, mode) for mode in ("hops", "latency", "bandwidth")]
    both = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return both.select("mode", "from_region", "to_region", "cost", "hops", _text("path").alias("path"))


@query(
    """WITH conf AS (SELECT least(src, dst) AS a, greatest(src, dst) AS z, min(metric * CASE WHEN least(src, dst) % 4 = 0 THEN 3 ELSE 1 END) AS expected FROM edges WHERE (src + dst) % 5 <> 0 GROUP BY ALL),
adj AS (SELECT src, dst, metric FROM edges WHERE src % 7 <> 3 UNION ALL SELECT dst, src, metric FROM edges WHERE dst % 3 <> 0 AND src % 7 <> 3),
two AS (SELECT least(src, dst) AS a, greatest(src, dst) AS z, min(metric) FILTER (src < dst) AS az, min(metric) FILTER (src > dst) AS za FROM adj GROUP BY ALL)
SELECT a, z, expected, az, za, CASE WHEN expected IS NULL THEN 'extra' WHEN az IS NULL AND za IS NULL THEN 'missing' WHEN az IS NULL OR za IS NULL THEN 'one_way' WHEN coalesce(az, za) / expected < 0.5 OR coalesce(az, za) / expected > 2 THEN 'metric' ELSE 'ok' END AS state
FROM conf FULL JOIN two USING (a, z)"""
)
def compare_topology(t):
    e = _edges(t)
    conf = e.filter("(src + dst) % 5 <> 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("z")).agg(F.min("metric").alias("m"))
    conf = conf.select("a", "z", (F.col("m") * F.when(F.col("a") % 4 == 0, 3).otherwise(1)).alias("expected"))
    e = e.filter("src % 7 <> 3").select("src", "dst", "metric")
    adj = e.unionByName(e.filter("dst % 3 <> 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "metric"))
    return graph.compare(conf, adj)


def _gone(name: str, cases: str, allowed: str) -> str:
    """Best paths in each case (scenario, a, b), the same way, and what they change."""
    begin = f"SELECT scenario, a, b, src, dst, p FROM ({OWN}) o CROSS JOIN ({cases}) c"
    step = STEP.format(keys="w.scenario, w.a, w.b, ", cost="w.p[1] + e.metric")
    out = BEST + ", " + _rounds("gone", begin, step, "scenario, a, b, src, dst", FEW, f"WHERE {allowed}")
    return out + f""", {name} AS (SELECT c.scenario, b.src, b.dst, b.p[1] AS before, b.p[3] AS path, g.p[1] AS after FROM ({cases}) c CROSS JOIN best b LEFT JOIN gone g USING (scenario, src, dst) WHERE b.src <> b.dst)
"""


DOWN = _gone("pairs", "SELECT n_nationkey AS scenario, n_nationkey AS a, n_nationkey AS b FROM nation", "e.dst <> w.a AND w.src <> w.a") + """, impact AS (
  SELECT scenario AS node, count(*) FILTER (list_contains(path, scenario)) AS n_affected, count(*) FILTER (after IS NULL) AS n_cut, count(*) FILTER (after > before) AS n_longer,
    CAST(coalesce(sum(after - before) FILTER (after > before), 0) AS BIGINT) AS added_cost, count(DISTINCT dst) FILTER (after IS NULL) AS n_nodes_cut,
    count(DISTINCT x.n_regionkey * 5 + y.n_regionkey) FILTER (list_contains(path, scenario) AND x.n_regionkey <> y.n_regionkey) AS n_regions
  FROM pairs JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst WHERE src <> scenario AND dst <> scenario GROUP BY 1)
"""


def _regions(t):
    return t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("region"))


def _impact(t, cases, edges):
    affected = graph.affected_pairs(edges, durable(graph.best_paths(edges, _nodes(t))), durable(cases))
    return graph.impact(cases, affected, _regions(t))


def _down(t, edges):
    node = F.col("n_nationkey")
    return _impact(t, t.nation.select(node.alias("scenario"), *graph.scenario(nodes=[node])), durable(edges)).withColumnRenamed("scenario", "node")


@query(DOWN + "SELECT node, n_cut, n_nodes_cut FROM impact WHERE n_cut > 0")
def unreachable_if_down(t):
    return _down(t, t.edges).filter("n_cut > 0").select("node", "n_cut", "n_nodes_cut")


@query(DOWN + "SELECT node, n_affected, n_cut, n_longer, added_cost FROM impact")
def failure_impact(t):
    return _down(t, t.edges).select("node", "n_affected", "n_cut", "n_longer", "added_cost")


ITEMS = _gone(
    "pairs",
    """SELECT 'node-' || n_nationkey AS scenario, n_nationkey AS a, n_nationkey AS b FROM nation UNION ALL SELECT DISTINCT 'link-' || least(src, dst) || '-' || greatest(src, dst), least(src, dst), greatest(src, dst) FROM edges""",
    "CASE WHEN w.a = w.b THEN e.dst <> w.a AND w.src <> w.a ELSE NOT (e.src = w.a AND e.dst = w.b) AND NOT (e.src = w.b AND e.dst = w.a) END",
)


@query(
    ITEMS
    + """, used AS (SELECT p.*, CASE WHEN starts_with(scenario, 'node') THEN list_contains(path, split_part(scenario, '-', 2)::INT) ELSE contains('>' || array_to_string(path, '>') || '>', '>' || split_part(scenario, '-', 2) || '>' || split_part(scenario, '-', 3) || '>')
    OR contains('>' || array_to_string(path, '>') || '>', '>' || split_part(scenario, '-', 3) || '>' || split_part(scenario, '-', 2) || '>') END AS hit FROM pairs p WHERE NOT (starts_with(scenario, 'node') AND (src = split_part(scenario, '-', 2)::INT OR dst = split_part(scenario, '-', 2)::INT))),
report AS (SELECT scenario, count(*) FILTER (hit) AS n_affected, count(*) FILTER (after IS NULL) AS n_cut, count(*) FILTER (after > before) AS n_longer, CAST(coalesce(sum(after - before) FILTER (after > before), 0) AS BIGINT) AS added_cost,
  count(DISTINCT x.n_regionkey * 5 + y.n_regionkey) FILTER (hit AND x.n_regionkey <> y.n_regionkey) AS n_regions FROM used JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst GROUP BY 1)
SELECT scenario, split_part(scenario, '-', 1) AS kind, n_affected, n_regions, n_cut, row_number() OVER (ORDER BY n_cut, n_longer, added_cost, scenario) AS place FROM report"""
)
def maintenance_report(t):
    edges, n = _edges(t), F.col("n_nationkey")
    a, z = F.least("src", "dst"), F.greatest("src", "dst")
    nodes = t.nation.select(F.concat_ws("-", F.lit("node"), n).alias("scenario"), F.lit("node").alias("kind"), *graph.scenario(nodes=[n]))
    links = edges.select(a.alias("a"), z.alias("z")).distinct()
    links = links.select(F.concat_ws("-", F.lit("link"), "a", "z").alias("scenario"), F.lit("link").alias("kind"), *graph.scenario(edges=[(F.col("a"), F.col("z"))]))
    found = graph.maintenance(edges, durable(graph.best_paths(edges, _nodes(t))), durable(nodes.unionByName(links)), _regions(t))
    return found.select("scenario", "kind", "n_affected", "n_regions", "n_cut", "place")


@query(DOWN + "SELECT scenario AS node, src, dst, before, after FROM pairs WHERE list_contains(path, scenario) AND src <> scenario AND dst <> scenario")
def failure_paths(t):
    edges, node = _edges(t), F.col("n_nationkey")
    cases = durable(t.nation.select(node.alias("scenario"), *graph.scenario(nodes=[node])))
    found = graph.affected_pairs(edges, durable(graph.best_paths(edges, _nodes(t))), cases)
    return found.select(F.col("scenario").alias("node"), "src", "dst", "before", "after")


@query(
    _gone("pairs", "SELECT DISTINCT least(src, dst) || '-' || greatest(src, dst) AS scenario, least(src, dst) AS a, greatest(src, dst) AS b FROM edges", "NOT (e.src = w.a AND e.dst = w.b) AND NOT (e.src = w.b AND e.dst = w.a)")
    + """SELECT scenario AS link, count(*) FILTER (after IS NULL) AS n_cut, count(*) FILTER (after > before) AS n_longer, CAST(coalesce(sum(after - before) FILTER (after > before), 0) AS BIGINT) AS added_cost FROM pairs GROUP BY 1"""
)
def removal_impact(t):
    e = durable(t.edges)
    a, z = F.least("src", "dst"), F.greatest("src", "dst")
    cases = e.select(F.concat_ws("-", a, z).alias("scenario"), a.alias("a"), z.alias("z")).distinct().select("scenario", *graph.scenario(edges=[(F.col("a"), F.col("z"))]))
    return _impact(t, cases, e).select(F.col("scenario").alias("link"), "n_cut", "n_longer", "added_cost")


CRITICAL = """WITH deg AS (SELECT node, count(DISTINCT other) AS n FROM (SELECT src AS node, dst AS other FROM mesh UNION ALL SELECT dst, src FROM mesh) GROUP BY node),
pairs AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS z FROM mesh),
places AS (SELECT c_custkey AS node, c_nationkey AS region FROM customer UNION ALL SELECT -s_suppkey, s_nationkey FROM supplier),
crit AS (SELECT a, z, x.n AS a_degree, y.n AS z_degree, CASE least(x.n, y.n) WHEN 1 THEN 'critical' WHEN 2 THEN 'important' ELSE 'redundant' END AS state FROM pairs JOIN deg x ON x.node = a JOIN deg y ON y.node = z)
"""


@query(CRITICAL + "SELECT * FROM crit")
def critical_links(t):
    return graph.critical_links(durable(t.mesh))


@query(
    CRITICAL
    + """SELECT 'leaf' AS kind, CAST(node AS VARCHAR) AS name, 'critical' AS severity FROM deg WHERE n = 1 UNION ALL SELECT 'link', a || '-' || z, 'critical' FROM crit WHERE state = 'critical'
UNION ALL SELECT 'region', CAST(x.region AS VARCHAR), 'warning' FROM (SELECT a, z FROM pairs UNION ALL SELECT z, a FROM pairs) p JOIN places x ON x.node = a JOIN places y ON y.node = z
WHERE x.region <> y.region GROUP BY x.region HAVING count(DISTINCT a) = 1"""
)
def redundancy_report(t):
    regions = t.customer.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("region")).unionByName(t.supplier.select((-F.col("s_suppkey")).alias("node"), F.col("s_nationkey").alias("region")))
    return graph.redundancy(durable(t.mesh), regions)


@query(
    BEST + ", " + HOPS + ", " + WIDE
    + """, sides AS (SELECT least(a.n_regionkey, b.n_regionkey) AS from_region, greatest(a.n_regionkey, b.n_regionkey) AS to_region, a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey)
SELECT from_region, to_region, count(*) AS n_paths, min(f.p[1]) AS min_hops, min(best.p[1]) AS min_metric, max(-w.p[1]) AS bottleneck
FROM best JOIN few f USING (src, dst) JOIN wide w USING (src, dst) JOIN sides USING (src, dst) GROUP BY ALL"""
)
def metro_connectivity(t):
    e, n = _edges(t), _nodes(t)
    return graph.region_matrix(graph.best_paths(e, n), graph.best_paths(e, n, cost="hops"), graph.best_paths(e, n, cost="bottleneck"), _regions(t))


@query(
    BEST
    + """, other AS (SELECT side_a AS src, side_z AS dst, avg(committed_rtt_us) AS other FROM links WHERE side_a <> side_z GROUP BY ALL)
SELECT b.src, b.dst, p[1] AS cost, round(other * 100, 6) AS other, round((other * 100 - p[1]) * 100 / (other * 100), 6) AS improvement_pct FROM best b JOIN other USING (src, dst)"""
)
def metro_path_latency(t):
    other = t.links.filter("side_a <> side_z").groupBy(F.col("side_a").alias("src"), F.col("side_z").alias("dst")).agg((F.avg("committed_rtt_us") * 100).alias("other"))
    rows = graph.best_paths(_edges(t), _nodes(t)).join(other, ["src", "dst"])
    return rows.select("src", "dst", "cost", F.round("other", 6).alias("other"), F.round((F.col("other") - F.col("cost")) * 100 / F.col("other"), 6).alias("improvement_pct"))


@query(
    BEST
    + f""", ranked AS (SELECT a.n_regionkey AS f, b.n_regionkey AS g, {PATH_TEXT} AS path, p[1] AS cost, row_number() OVER (PARTITION BY a.n_regionkey, b.n_regionkey ORDER BY p) AS n FROM best JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey)
SELECT f AS from_region, g AS to_region, path, cost FROM ranked WHERE n = 1"""
)
def metro_path_detail(t):
    region = lambda c, n: t.nation.select(F.col("n_nationkey").alias(c), F.col("n_regionkey").alias(n))
    rows = graph.best_paths(_edges(t), _nodes(t)).join(region("src", "from_region"), "src").join(region("dst", "to_region"), "dst").filter("from_region <> to_region")
    best = rows.groupBy("from_region", "to_region").agg(F.min(F.struct("cost", "hops", "path")).alias("p"))
    return best.select("from_region", "to_region", _text("p.path").alias("path"), "p.cost")


@query(BEST + f"SELECT src, dst, p[1] AS cost, {PATH_TEXT} AS path FROM best JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey = 1 AND b.n_regionkey = 3")
def metro_device_paths(t):
    at = lambda c, r: t.nation.filter(F.col("n_regionkey") == r).select(F.col("n_nationkey").alias(c))
    rows = graph.best_paths(_edges(t), at("src", 1)).join(at("dst", 3), "dst", "left_semi")
    return rows.select("src", "dst", "cost", _text("path").alias("path"))


@query(BEST + f"SELECT src AS publisher, dst AS subscriber, p[1] AS cost, {PATH_TEXT} AS path FROM best JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey = 1 AND b.n_regionkey <> 1")
def multicast_tree_paths(t):
    publishers = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("src"))
    members = t.nation.filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("dst"))
    rows = graph.best_paths(_edges(t), publishers).join(members, "dst", "left_semi")
    return rows.select(F.col("src").alias("publisher"), F.col("dst").alias("subscriber"), "cost", _text("path").alias("path"))


@query(
    BEST
    + """, cand AS (SELECT a.n_nationkey * 100 + b.n_nationkey AS scenario, a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 9) % 25),
ways AS (SELECT scenario, a, b FROM cand UNION ALL SELECT scenario, b, a FROM cand), d AS (SELECT src, dst, p[1] AS d FROM best),
via AS (SELECT w.scenario, x.src AS u, y.dst AS v, min(x.d + 1000 + y.d) AS after FROM ways w JOIN d x ON x.dst = w.a JOIN d y ON y.src = w.b WHERE x.src <> y.dst GROUP BY ALL)
SELECT scenario, count(*) FILTER (d IS NULL OR after < d) AS n_improved, CAST(coalesce(sum(d - after) FILTER (after < d), 0) AS BIGINT) AS saved FROM via LEFT JOIN d ON d.src = u AND d.dst = v GROUP BY 1"""
)
def addition_impact(t):
    a = F.col("n_nationkey")
    b = (a + 9) % 25
    cand = t.nation.select((a * 100 + b).alias("scenario"), a.alias("a"), b.alias("b"), F.lit(1000).cast("long").alias("metric"))
    return graph.addition_impact(graph.best_paths(_edges(t), _nodes(t)), cand)


@query()  # SQL has no search without one removal a link; tests compare with that on random graphs
def bridge_links(t):
    from ..operators.bridges import bridges

    return bridges(durable(t.mesh))


@query(
    G
    + HOPS
    + """, lens AS (SELECT src, dst, p[2] AS hops FROM few WHERE src <> dst),
one AS (SELECT src, dst, src::VARCHAR || '>' || dst::VARCHAR AS path, 1 AS n FROM g), two AS (SELECT a.src, b.dst, a.path || '>' || b.dst::VARCHAR AS path, 2 AS n FROM one a JOIN g b ON a.dst = b.src),
three AS (SELECT a.src, b.dst, a.path || '>' || b.dst::VARCHAR AS path, 3 AS n FROM two a JOIN g b ON a.dst = b.src),
found AS (SELECT p.src, p.dst, hops, path FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) p JOIN lens l ON l.src = p.src AND l.dst = p.dst AND l.hops = p.n)
SELECT src, dst, hops, count(*) OVER (PARTITION BY src, dst) AS n_paths, path FROM found"""
)
def equal_hop_paths(t):
    steps = durable(graph.predecessors(_edges(t), _nodes(t)))
    rows = graph.equal_hop_paths(steps, steps.select("src", F.col("node").alias("dst")))
    return rows.select("src", "dst", "hops", "n_paths", _text("path").alias("path"))


@query(
    """WITH two AS (SELECT src AS node, dst AS other FROM mesh UNION SELECT dst, src FROM mesh), leaves AS (SELECT node, min(other) AS sole FROM two GROUP BY node HAVING count(*) = 1),
cand AS (SELECT c_custkey AS scenario, c_custkey AS a, -min(s_suppkey) AS b FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY c_custkey),
ends AS (SELECT scenario, a AS node, b AS "to" FROM cand UNION ALL SELECT scenario, b, a FROM cand)
SELECT DISTINCT scenario, node FROM ends JOIN leaves USING (node) WHERE "to" <> sole"""
)
def addition_gains(t):
    """What a link from each customer to its nation's first supplier would make redundant."""
    first = t.supplier.groupBy("s_nationkey").agg((-F.min("s_suppkey")).alias("b"))
    near = t.customer.join(F.broadcast(first), F.col("s_nationkey") == F.col("c_nationkey"))  # a row a nation
    return graph.redundancy_gains(durable(t.mesh), near.select(F.col("c_custkey").alias("scenario"), F.col("c_custkey").alias("a"), "b"))
