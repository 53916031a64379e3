"""Traffic: rates of interfaces, combined per entity, bucket and dimension.

Counters: event_ts, device_pk, intf, link_pk, in_octets, out_octets, seconds, errors, discards, carrier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamped_sum, mean_rate, peak_rate, ratio


def valid(counters: DataFrame) -> DataFrame:
    """Rows that give a rate: deltas of 0 or more over some time."""
    return counters.filter((F.col("in_octets") >= 0) & (F.col("out_octets") >= 0) & (F.col("seconds") > 0))


def interface_rates(counters: DataFrame, by: list[str], bucket: str | None = None, ts: str = "event_ts") -> DataFrame:
    """Mean and peak bits per second of each key, and bucket if given."""
    keys = [F.col(k) for k in by] + ([F.date_trunc(bucket, ts).alias("bucket")] if bucket else [])
    return valid(counters).groupBy(*keys).agg(
        mean_rate(F.col("in_octets"), F.col("seconds")).alias("in_bps"), mean_rate(F.col("out_octets"), F.col("seconds")).alias("out_bps"),
        peak_rate(F.col("in_octets"), F.col("seconds")).alias("peak_in_bps"), peak_rate(F.col("out_octets"), F.col("seconds")).alias("peak_out_bps"),
    )


def sum_of_rates(counters: DataFrame, entity: list[str]) -> DataFrame:
    """Totals of an entity: the sum of its interfaces' mean rates, never the rate of their sums."""
    per = interface_rates(counters, [*entity, *[k for k in ("device_pk", "intf") if k not in entity]])
    return per.groupBy(*entity).agg(F.sum("in_bps").alias("in_bps"), F.sum("out_bps").alias("out_bps"))


def total_throughput(counters: DataFrame) -> DataFrame:
    per = interface_rates(counters, ["device_pk", "intf"])
    return per.agg(F.sum("in_bps").alias("in_bps"), F.sum("out_bps").alias("out_bps"), F.count("*").alias("n_interfaces"))


def stress(counters: DataFrame, bandwidth: DataFrame, dims: DataFrame, *, group: str, bucket: str, threshold: float, metric: str = "utilization") -> DataFrame:
    """Per bucket and group: percentiles of the peak of interfaces, in and out apart, and how many are over the threshold.

    metric: 'utilization' in percent of the bandwidth, 'throughput' in bits, or 'packets', per second. Interfaces are reduced to one row per
    bucket before the dimensions are joined.
    """
    if metric not in ("utilization", "throughput", "packets"):
        raise ValueError(metric)
    keys = ["device_pk", "intf", "link_pk"]
    if metric == "packets":
        peak = lambda c: F.max(ratio(F.col(c), F.col("seconds")))
        per = valid(counters).groupBy(*keys, F.date_trunc(bucket, "event_ts").alias("bucket")).agg(peak("in_packets").alias("i"), peak("out_packets").alias("o"))
    else:
        per = interface_rates(counters, keys, bucket).withColumns({"i": F.col("peak_in_bps"), "o": F.col("peak_out_bps")})
    if metric == "utilization":
        per = per.join(bandwidth, "link_pk").withColumns({c: ratio(F.col(c) * 100, F.col("bandwidth_bps")) for c in ("i", "o")})
    used = per.join(dims, "device_pk").select("bucket", group, "i", "o")
    p = lambda c, q: F.percentile(c, F.lit(q))
    return used.groupBy("bucket", group).agg(
        p("i", 0.5).alias("p50_in"), p("i", 0.95).alias("p95_in"), F.max("i").alias("max_in"), p("o", 0.5).alias("p50_out"), p("o", 0.95).alias("p95_out"), F.max("o").alias("max_out"),
        F.count_if((F.col("i") >= threshold) | (F.col("o") >= threshold)).alias("n_stressed"), F.count("*").alias("n"),
    )


def top(counters: DataFrame, by: list[str], *, bucket: str, k: int, metric: str = "max_bps") -> DataFrame:
    """The k entities with the largest metric of max_bps, avg_bps and p95_bps over their buckets; ties by key."""
    busy = interface_rates(counters, by, bucket).withColumn("bps", F.greatest("in_bps", "out_bps"))
    found = busy.groupBy(*by).agg(F.max("bps").alias("max_bps"), F.avg("bps").alias("avg_bps"), F.percentile("bps", F.lit(0.95)).alias("p95_bps"))
    return found.orderBy(F.col(metric).desc(), *by).limit(k)


def headroom(counters: DataFrame, bandwidth: DataFrame, *, bucket: str, k: int) -> DataFrame:
    """The k interfaces with the least room left at their busiest bucket, with the 95th percentile of their use. bandwidth: (link_pk, bandwidth_bps)."""
    busy = interface_rates(counters, ["device_pk", "intf", "link_pk"], bucket).withColumn("bps", F.greatest("in_bps", "out_bps")).join(bandwidth, "link_pk")
    use = ratio(F.col("bps") * 100, F.col("bandwidth_bps"))
    found = busy.groupBy("device_pk", "intf", "link_pk").agg(F.max("bps").alias("max_bps"), F.percentile(use, F.lit(0.95)).alias("p95_pct"), F.first("bandwidth_bps").alias("bandwidth_bps"))
    rows = found.withColumn("headroom_bps", F.col("bandwidth_bps") - F.col("max_bps"))
    return rows.orderBy("headroom_bps", "device_pk", "intf", "link_pk").limit(k)


def burstiness_of_use(counters: DataFrame, bandwidth: DataFrame, *, bucket: str, least_pct: float) -> DataFrame:
    """(device_pk, intf, p50_pct, p99_pct, spread_pct): how far the 99th percentile of use lies above the median, from least_pct on."""
    rates = interface_rates(counters, ["device_pk", "intf", "link_pk"], bucket).join(bandwidth, "link_pk")
    use = ratio(F.greatest("in_bps", "out_bps") * 100, F.col("bandwidth_bps"))
    found = rates.groupBy("device_pk", "intf").agg(F.percentile(use, F.lit(0.5)).alias("p50_pct"), F.percentile(use, F.lit(0.99)).alias("p99_pct"))
    return found.withColumn("spread_pct", F.col("p99_pct") - F.col("p50_pct")).filter(F.col("spread_pct") >= least_pct)


def item_rates(counters: DataFrame, kind: str, item, bucket: str) -> DataFrame:
    """(bucket, rates, packets per second) of one link, device or tunnel; those of a device are sums of its interfaces' rates."""
    column = {"link": "link_pk", "device": "device_pk", "tunnel": "tunnel_id"}[kind]
    per = packet_rates(counters.filter(F.col(column) == item), ["device_pk", "intf"], bucket)
    return per.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("in_bps", "out_bps", "in_pps", "out_pps")])


def packet_rates(counters: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Mean bits and packets per second of each key and bucket."""
    per = lambda c: ratio(F.sum(c), F.sum("seconds"))
    return valid(counters).groupBy(*by, F.date_trunc(bucket, "event_ts").alias("bucket")).agg(
        (per("in_octets") * 8).alias("in_bps"), (per("out_octets") * 8).alias("out_bps"), per("in_packets").alias("in_pps"), per("out_packets").alias("out_pps")
    )


def interface_issues(counters: DataFrame, devices: DataFrame, links: DataFrame, *, start: Column) -> DataFrame:
    """Interfaces with errors, FCS errors, discards or carrier changes since a time: sums, first and last sight, and device and link by name."""
    kinds = ("errors", "fcs", "discards", "carrier")
    bad = F.when(F.greatest(*kinds) > 0, F.col("event_ts"))
    rows = counters.filter(F.col("event_ts") >= start).groupBy("device_pk", "intf", "link_pk")
    found = rows.agg(*[clamped_sum(F.col(c)).alias(c) for c in kinds], F.min(bad).alias("first_seen"), F.max(bad).alias("last_seen")).filter(F.greatest(*kinds) > 0)
    names = devices.select("device_pk", F.col("code").alias("device")), links.select("link_pk", F.col("code").alias("link"))
    return found.join(names[0], "device_pk", "left").join(names[1], "link_pk", "left")


def burstiness(counters: DataFrame, by: list[str], *, bucket: str, threshold_bps: float, least_bps: float) -> DataFrame:
    """p99 over p50 less 1, share of buckets over the threshold, and the direction and bucket of the peak."""
    rates = interface_rates(counters, by, bucket).withColumn("bps", F.greatest("in_bps", "out_bps"))
    found = rates.groupBy(*by).agg(
        F.percentile("bps", F.lit(0.5)).alias("p50_bps"), F.percentile("bps", F.lit(0.99)).alias("p99_bps"), (F.count_if(F.col("bps") >= threshold_bps) * 100.0 / F.count("*")).alias("stressed_pct"),
        F.max_by(F.when(F.col("in_bps") >= F.col("out_bps"), "in").otherwise("out"), F.struct("bps", "bucket")).alias("peak_direction"),
    )
    return found.filter(F.col("p99_bps") >= least_bps).withColumn("burstiness", ratio(F.col("p99_bps"), F.col("p50_bps")) - 1)


def health_rank(counters: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k interfaces with the most errors, FCS errors, discards and carrier changes."""
    kinds = [c for c in ("errors", "fcs", "discards", "carrier") if c in counters.columns]
    sums = counters.groupBy(*by).agg(*[clamped_sum(F.col(c)).alias(c) for c in kinds])
    total = sum((F.col(c) for c in kinds), F.lit(0).cast("long"))
    return sums.withColumn("total", total).filter("total > 0").orderBy(F.col("total").desc(), *by).limit(k)


def series(counters: DataFrame, by: list[str], *, bucket: str) -> DataFrame:
    """Rates per bucket, with the mean of each series beside them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    return interface_rates(counters, by, bucket).withColumn("mean_in_bps", F.avg("in_bps").over(w)).withColumn("mean_out_bps", F.avg("out_bps").over(w))


def discards(counters: DataFrame, *, bucket: str) -> DataFrame:
    from pyspark.sql import Window

    per = counters.groupBy("device_pk", "intf", F.date_trunc(bucket, "event_ts").alias("bucket")).agg(clamped_sum(F.col("discards")).alias("discards"))
    return per.withColumn("total", F.sum("discards").over(Window.partitionBy("device_pk", "intf"))).filter("total > 0")


def perspective(rates: DataFrame, who: str) -> DataFrame:
    """What a device receives its user sends: 'user' swaps in and out."""
    if who not in ("user", "device"):
        raise ValueError(who)
    if who == "device":
        return rates
    swap = {"in_bps": F.col("out_bps"), "out_bps": F.col("in_bps")}
    return rates.select(*[swap.get(c, F.col(c)).alias(c) for c in rates.columns])


def interface_kind(intf: Column) -> Column:
    return F.when(F.lower(intf).startswith("tunnel"), "tunnel").when(F.lower(intf).rlike("^(ethernet|port)"), "link").otherwise("other")


def group_members(users: DataFrame) -> DataFrame:
    """(group_pk, user_pk, mode) from users with arrays of the groups that they publish and subscribe to: P, S or P+S."""
    one = lambda c, m: users.select(F.explode(c).alias("group_pk"), "user_pk", F.lit(m).alias("m"))
    both = one("publishers", "P").unionByName(one("subscribers", "S"))
    return both.groupBy("group_pk", "user_pk").agg(F.array_join(F.sort_array(F.collect_set("m")), "+").alias("mode"))


def group_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("group_pk").agg(F.count_if(F.col("mode").contains("P")).alias("n_publishers"), F.count_if(F.col("mode").contains("S")).alias("n_subscribers"), F.count("*").alias("n_members"))


def group_traffic(members: DataFrame, tunnels: DataFrame, counters: DataFrame, *, bucket: str) -> DataFrame:
    """(group_pk, mode, bucket, bps): for each multicast group the sum over its members of the mean rate on the interface that carries
    their tunnel. tunnels: user_pk, device_pk, intf. Rates are made row by row, then averaged, then summed."""
    rate = counters.groupBy("device_pk", "intf", F.date_trunc(bucket, "event_ts").alias("bucket")).agg(F.avg(F.col("in_octets") * 8 / F.col("seconds")).alias("bps"))
    rows = members.join(tunnels, "user_pk").join(rate, ["device_pk", "intf"])
    return rows.groupBy("group_pk", "mode", "bucket").agg(F.sum("bps").alias("bps"))


def metro_detail(metros: DataFrame, devices: DataFrame, links: DataFrame, validators: DataFrame) -> DataFrame:
    """The given metros with what stands there: devices, links that end there (once each), validators with stake, and their stake."""
    n_devices = devices.groupBy("metro_pk").agg(F.count("*").alias("n_devices"))
    ends = links.select(F.explode(F.array_distinct(F.array("side_a", "side_z"))).alias("metro_pk"))
    n_links = ends.groupBy("metro_pk").agg(F.count("*").alias("n_links"))
    staked = validators.groupBy("metro_pk").agg(F.count_if(F.col("stake") > 0).alias("n_validators"), F.sum("stake").alias("stake"))
    rows = metros.select("metro_pk", "code", "region_pk").join(n_devices, "metro_pk", "left").join(n_links, "metro_pk", "left").join(staked, "metro_pk", "left")
    return rows.na.fill(0, ["n_devices", "n_links", "n_validators", "stake"])


def contributor_detail(contributor_pk: int, devices: DataFrame, links: DataFrame, counters: DataFrame) -> DataFrame:
    """A contributor's devices, links and drained links, its bandwidth, and the sum of what comes in over its interfaces."""
    mine = devices.filter(F.col("contributor_pk") == contributor_pk).select("device_pk")
    own = links.filter(F.col("contributor_pk") == contributor_pk).agg(F.count("*").alias("n_links"), F.count_if(F.col("status") != "activated").alias("n_drained"), F.sum("bandwidth_bps").alias("bandwidth_bps"))
    rates = counters.join(mine, "device_pk").groupBy("device_pk", "intf").agg((F.sum("in_octets") * 8 / F.sum("seconds")).alias("bps"))
    rows = own.crossJoin(mine.agg(F.count("*").alias("n_devices"))).crossJoin(rates.agg(F.sum("bps").alias("in_bps")))  # one row each
    return rows.select(F.lit(contributor_pk).alias("contributor_pk"), "n_devices", "n_links", "n_drained", "bandwidth_bps", "in_bps")


def user_detail(users: DataFrame, sessions: DataFrame) -> DataFrame:
    """The given users with their sessions: how many, the first, the last, and whether the newest is open.

    sessions: user_pk, at, version, is_connected. Users without sessions have 0 and nulls.
    """
    seen = sessions.groupBy("user_pk").agg(F.count("*").alias("n_sessions"), F.min("at").alias("first_session"), F.max("at").alias("last_session"), F.max_by("is_connected", F.struct("at", "version")).alias("is_connected"))
    return users.join(seen, "user_pk", "left").na.fill(0, ["n_sessions"])
