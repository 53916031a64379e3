"""Lists and sums over several tables: what stands beside each link, validator and node, and the network as a whole.

All take current states; facts are reduced to one row a key before they are joined. Pages are cut by functions.filters.page().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent, ratio


def _named(metros: DataFrame, key: str, name: str) -> DataFrame:
    return metros.select(F.col("metro_pk").alias(key), F.col("code").alias(name))


def links(rows: DataFrame, latency: DataFrame, rates: DataFrame, metros: DataFrame, *, as_of: Column | None = None) -> DataFrame:
    """Links with both metros, mean round trip (and of each direction), loss, and use of each direction.

    latency: link_pk, event_ts, rtt_us, loss, direction, up to as_of if that is given; rates: link_pk, in_bps, out_bps.
    """
    seen = latency if as_of is None else latency.filter(F.col("event_ts") <= as_of)
    good = F.when(F.col("rtt_us") > 0, F.col("rtt_us"))
    way = lambda d: F.avg(F.when(F.col("direction") == d, good))
    stats = seen.groupBy("link_pk").agg(F.avg(good).alias("avg_rtt_us"), way(0).alias("a_to_z_us"), way(1).alias("z_to_a_us"), percent(F.col("loss")).alias("loss_pct"), F.count("*").alias("n_samples"))
    use = rates.select("link_pk", "in_bps", "out_bps")
    out = rows.join(_named(metros, "side_a", "a"), "side_a").join(_named(metros, "side_z", "z"), "side_z").join(stats, "link_pk", "left").join(use, "link_pk", "left")
    pct = lambda c: ratio(F.col(c) * 100, F.col("bandwidth_bps"))
    return out.select(
        "link_pk", "code", "a", "z", "status", "avg_rtt_us", "a_to_z_us", "z_to_a_us", "loss_pct", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), pct("in_bps").alias("in_pct"), pct("out_bps").alias("out_pct")
    )


def validators(ranked: DataFrame, performance: DataFrame, rates: DataFrame) -> DataFrame:
    """Validators by stake (see validators.ranked) with vote lag, skip rate, and what comes in and goes out over their tunnels. rates: node, in_bps, out_bps."""
    own = performance.select("node", "avg_lag", "skip_pct", "is_delinquent")
    return ranked.join(own, "node", "left").join(rates.select("node", "in_bps", "out_bps"), "node", "left")


def gossip_nodes(nodes: DataFrame, stakes: DataFrame, connected: DataFrame, places: DataFrame) -> DataFrame:
    """Gossip nodes (node, address) with stake, whether they validate and are connected, and where their address lies.

    stakes: node, stake; connected: node; places: ip and attributes, see geo.longest_prefix(). Nodes without a place have nulls.
    """
    held = stakes.groupBy("node").agg(F.sum("stake").alias("stake"))
    on = connected.select("node", F.lit(True).alias("is_on")).distinct()
    rows = nodes.join(held, "node", "left").join(on, "node", "left").join(places.withColumnRenamed("ip", "address"), "address", "left")
    rest = [c for c in places.columns if c != "ip"]
    stake = F.coalesce("stake", F.lit(0.0))
    return rows.select("node", "address", stake.alias("stake"), (stake > 0).alias("is_validator"), F.coalesce("is_on", F.lit(False)).alias("is_on"), *rest)


def summary(links: DataFrame, devices: DataFrame, metros: DataFrame, stakes: DataFrame, users: DataFrame, tunnels: DataFrame) -> DataFrame:
    """One row over the network: counts, bandwidth, users and their mean rate, connected stake and its share.

    stakes: stake, is_on; users: status; tunnels: in_bps, one row a tunnel. All that is joined has one row.
    """
    parts = [
        links.agg(F.count_if(F.col("status") == "activated").alias("n_links"), F.count_distinct("contributor_pk").alias("n_contributors"), F.sum("bandwidth_bps").alias("bandwidth_bps")),
        devices.agg(F.count("*").alias("n_devices")),
        metros.agg(F.count("*").alias("n_metros")),
        stakes.agg(F.count_if(F.col("stake") > 0).alias("n_validators"), F.sum(F.when(F.col("is_on"), F.col("stake")).otherwise(0.0)).alias("on_stake"), F.sum("stake").alias("total_stake")),
        users.agg(F.count_if(F.col("status") == "activated").alias("n_users")),
        tunnels.agg(F.avg("in_bps").alias("user_bps")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))
    return row.withColumn("stake_share_pct", ratio(F.col("on_stake") * 100, F.col("total_stake"))).drop("total_stake")


def topology(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """(kind, a, b): nodes (a in b) and edges (a to b) of all kinds, as one table. Each frame has columns a and b."""
    out = None
    for kind, df in {**nodes, **edges}.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out
