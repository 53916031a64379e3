"""Health of links and devices, and latency compared between networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamped_sum, is_lost, mean_rate, ratio

#: Percent over the committed round trip, percent lost, and percent used, for a warning and for a critical state.
LATENCY_PCT, LOSS_PCT, USED_PCT = (20.0, 50.0), (1.0, 10.0), (70.0, 90.0)
#: Fixed values of the service level: percent lost, and times the committed round trip.
SLA_LOSS, SLA_RTT = (0.1, 10.0), (1.5, 2.0)
#: Percent used above which a bucket of a link is worn, and what an interface counts in a bucket to make it unhealthy.
BUSY_PCT, MANY = 80.0, 100
#: Fixed values of the verdict: percent of links that are unhealthy, and that are degraded, above which all is called so.
VERDICT_PCT = (10.0, 20.0)


def links_health(latency: DataFrame, links: DataFrame, *, as_of: Column, lookback: str = "1 HOUR", recent: str = "5 MINUTES", dark_after: str = "2 HOURS", strict: bool = True) -> DataFrame:
    """Each link with loss, mean and 95th percentile of its good samples, and flags; one scan of the samples for all windows.

    is_down: all samples of the recent window are lost; is_dark: nothing was heard for dark_after (or ever).
    """
    since = lambda d: F.col("event_ts") >= as_of - F.expr(f"INTERVAL {d}")
    lost = is_lost(F.col("loss"), F.col("rtt_us"), strict=strict)
    inside, now = since(lookback), since(recent)
    good = F.when(inside & ~lost, F.col("rtt_us"))
    stats = (
        latency.filter(F.col("event_ts") <= as_of)
        .groupBy("link_pk")
        .agg(
            F.count_if(inside).alias("n_samples"),
            ratio(F.count_if(inside & lost) * 100.0, F.count_if(inside)).alias("loss_pct"),
            F.avg(good).alias("avg_rtt_us"),
            F.percentile(good, F.lit(0.95)).alias("p95_rtt_us"),
            F.max("event_ts").alias("last_seen"),
            (F.count_if(now & lost) > 0).alias("some_lost_now"),
            (F.count_if(now & ~lost) > 0).alias("some_good_now"),
        )
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    return links.join(stats, "link_pk", "left").select(
        "link_pk", "code", "status", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "loss_pct", "avg_rtt_us", "p95_rtt_us", "committed_rtt_us", "last_seen",
        (F.col("status") == "soft-drained").alias("is_soft_drained"),
        (F.col("status") == "hard-drained").alias("is_hard_drained"),
        (F.col("delay_override_ns") > 0).alias("is_override"),
        yes(F.col("avg_rtt_us") > F.col("committed_rtt_us")).alias("exceeds_committed"),
        (F.col("last_seen").isNull() | (F.col("last_seen") < as_of - F.expr(f"INTERVAL {dark_after}"))).alias("is_dark"),
        yes(F.col("some_lost_now") & ~F.col("some_good_now")).alias("is_down"),
    )


def sla(loss: Column, avg_rtt: Column, committed: Column) -> Column:
    over = F.coalesce(ratio(avg_rtt, committed), F.lit(0.0))
    return (
        F.when(loss.isNull(), "unknown")
        .when((loss >= SLA_LOSS[1]) | (over >= SLA_RTT[1]), "critical")
        .when((loss >= SLA_LOSS[0]) | (over >= SLA_RTT[0]), "warning")
        .otherwise("healthy")
    )


def classify_link(avg_rtt: Column, loss: Column, committed: Column) -> Column:
    over = F.when((committed > 0) & (avg_rtt > 0), (avg_rtt - committed) / F.nullif(committed, F.lit(0.0)) * 100)
    over = F.coalesce(over, F.lit(0.0))
    return F.when((loss >= LOSS_PCT[1]) | (over >= LATENCY_PCT[1]), "unhealthy").when((loss >= LOSS_PCT[0]) | (over >= LATENCY_PCT[0]), "degraded").otherwise("healthy")


def classify_device(errors: Column, discards: Column, carrier: Column, drained: Column) -> Column:
    """By the worst of the three counts of a bucket; they are not added up."""
    most = F.greatest(*[F.coalesce(c, F.lit(0)) for c in (errors, discards, carrier)])
    return F.when(drained, "disabled").when(most >= MANY, "unhealthy").when(most > 0, "degraded").otherwise("healthy")


def judged_rtt(links: DataFrame) -> Column:
    """The committed round trip of a WAN link between two metros; 0, which no latency exceeds, for others."""
    inside = F.lit(False)
    if "link_type" in links.columns:
        inside = inside | (F.col("link_type") != "WAN")
    if {"side_a", "side_z"} <= set(links.columns):
        inside = inside | (F.col("side_a") == F.col("side_z"))
    return F.when(F.coalesce(inside, F.lit(False)), F.lit(0.0)).otherwise(F.col("committed_rtt_us"))


def spine(start: Column, end: Column, step: str) -> Column:
    """All bucket starts in [start, end)."""
    return F.explode(F.sequence(start, end - F.expr(f"INTERVAL {step}"), F.expr(f"INTERVAL {step}")))


def link_usage(counters: DataFrame, links: DataFrame, *, bucket: str) -> DataFrame:
    """(link_pk, bucket, in_pct, out_pct, errors, discards, carrier): the mean rate of each direction over the bucket against the
    link's bandwidth, and what its interfaces counted; counter resets don't count."""
    sums = counters.filter("link_pk IS NOT NULL").groupBy("link_pk", F.window("event_ts", bucket)["start"].alias("bucket")).agg(
        mean_rate(F.col("in_octets"), F.col("seconds")).alias("in_bps"),
        mean_rate(F.col("out_octets"), F.col("seconds")).alias("out_bps"),
        *[clamped_sum(F.col(c)).alias(c) for c in ("errors", "discards", "carrier")],
    )
    rows = sums.join(links.select("link_pk", "bandwidth_bps"), "link_pk")
    used = [ratio(F.col(f"{d}_bps") * 100.0, F.when(F.col("bandwidth_bps") > 0, F.col("bandwidth_bps"))).alias(f"{d}_pct") for d in ("in", "out")]
    return rows.select("link_pk", "bucket", *used, "errors", "discards", "carrier")


def link_history(
    latency: DataFrame, links: DataFrame, *, start: Column, end: Column, bucket: str = "1 HOUR", dead_pct: float = 99.9, dead_buckets: int = 2, usage: DataFrame | None = None
) -> DataFrame:
    """(link_pk, bucket, status, reasons) for every link and bucket, with and without samples.

    Drained links are disabled, and so are links whose samples are all but lost for dead_buckets buckets in a row. Latency counts for WAN links
    between metros. usage: see link_usage(); MANY or more errors, discards or carrier changes make a healthy or degraded link
    unhealthy, fewer a healthy one degraded, and so does use over BUSY_PCT in either direction.
    """
    lost = is_lost(F.col("loss"), F.col("rtt_us"))
    inside = latency.filter((F.col("event_ts") >= start) & (F.col("event_ts") < end))
    stats = inside.groupBy("link_pk", F.window("event_ts", bucket)["start"].alias("bucket")).agg(
        (F.count_if(lost) * 100.0 / F.count("*")).alias("loss_pct"), F.avg(F.when(~lost, F.col("rtt_us"))).alias("avg_rtt_us")
    )
    every = links.select("link_pk", "status", judged_rtt(links).alias("committed_rtt_us")).withColumn("bucket", spine(start, end, bucket))
    rows = every.join(stats, ["link_pk", "bucket"], "left").withColumn("dead", F.coalesce(F.col("loss_pct") >= dead_pct, F.lit(False)))
    w = Window.partitionBy("link_pk").orderBy("bucket")
    # Dead for dead_buckets in a row: this bucket lies in such a run if the dead ones around it are many enough, so one sort serves.
    back = F.max(F.when(~F.col("dead"), F.col("bucket"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(~F.col("dead"), F.col("bucket"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    step = F.expr(f"INTERVAL {bucket}")
    first = F.coalesce(back + step, start.cast("timestamp"))
    rows = rows.withColumn("run_length", F.round((F.coalesce(ahead, end.cast("timestamp")).cast("double") - first.cast("double")) / ((start + step).cast("double") - start.cast("double"))))
    drained = F.col("status") != "activated"
    gone = F.col("dead") & (F.col("run_length") >= dead_buckets)
    state = F.when(drained | gone, "disabled").when(F.col("loss_pct").isNull(), "no_data").otherwise(classify_link(F.col("avg_rtt_us"), F.col("loss_pct"), F.col("committed_rtt_us")))
    if usage is not None:
        rows = rows.withColumn("state", state).join(usage, ["link_pk", "bucket"], "left")
        most = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("errors", "discards", "carrier")])
        busy = F.greatest(F.coalesce("in_pct", F.lit(0.0)), F.coalesce("out_pct", F.lit(0.0))) > BUSY_PCT
        state = (
            F.when((most >= MANY) & F.col("state").isin("healthy", "degraded"), "unhealthy")
            .when(((most > 0) | busy) & (F.col("state") == "healthy"), "degraded")
            .otherwise(F.col("state"))
        )
    over = ratio((F.col("avg_rtt_us") - F.col("committed_rtt_us")) * 100, F.col("committed_rtt_us"))
    tests = [("drained", drained), ("packet_loss", F.col("loss_pct") >= LOSS_PCT[0]), ("high_latency", over >= LATENCY_PCT[0]), ("no_data", F.col("loss_pct").isNull()), ("dead", gone)]
    if usage is not None:
        tests += [("interface_errors", F.col("errors") > 0), ("discards", F.col("discards") > 0), ("carrier_transitions", F.col("carrier") > 0), ("high_utilization", busy)]
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in tests]))
    return rows.select("link_pk", "bucket", state.alias("status"), reasons.alias("reasons"))


def device_history(counters: DataFrame, devices: DataFrame, *, bucket: str) -> DataFrame:
    """(device_pk, bucket, errors, discards, carrier, status) by truncated time; resets of counters don't count."""
    counted = ("errors", "discards", "carrier")
    sums = counters.groupBy("device_pk", F.date_trunc(bucket, "event_ts").alias("bucket")).agg(*[clamped_sum(F.col(c)).alias(c) for c in counted])
    state = classify_device(*[F.col(c) for c in counted], F.col("drained"))
    return sums.join(devices.select("device_pk", (F.col("status") != "activated").alias("drained")), "device_pk").select("device_pk", "bucket", *counted, state.alias("status"))


def interface_history(counters: DataFrame, *, bucket: str) -> DataFrame:
    return counters.groupBy("device_pk", "intf", F.date_trunc(bucket, "event_ts").alias("bucket")).agg(
        clamped_sum(F.col("errors")).alias("errors"), clamped_sum(F.col("discards")).alias("discards"), clamped_sum(F.col("carrier")).alias("carrier")
    )


def jitter(latency: DataFrame) -> dict[str, Column]:
    """Mean, 95th percentile and maximum of the change between samples, if latency has it (ipdv_us)."""
    if "ipdv_us" not in latency.columns:
        return {}
    c = F.col("ipdv_us")
    return {"avg_jitter_us": F.avg(c), "p95_jitter_us": F.percentile(c, F.lit(0.95)), "max_jitter_us": F.max(c)}


def network_performance(latency: DataFrame, links: DataFrame, *, as_of: Column, lookback: str) -> DataFrame:
    """One row over WAN links; loss is counted before lost samples are left out."""
    wan = latency.filter((F.col("event_ts") <= as_of) & (F.col("event_ts") > as_of - F.expr(f"INTERVAL {lookback}"))).join(links.filter("link_type = 'WAN'").select("link_pk"), "link_pk", "left_semi")
    lost = is_lost(F.col("loss"), F.col("rtt_us"))
    good = F.when(~lost, F.col("rtt_us"))
    return wan.agg(
        F.avg(good).alias("avg_rtt_us"), F.percentile(good, F.lit(0.95)).alias("p95_rtt_us"), F.min(good).alias("min_rtt_us"), F.max(good).alias("max_rtt_us"),
        ratio(F.count_if(lost) * 100.0, F.count("*")).alias("loss_pct"), F.count("*").alias("n"), *[c.alias(k) for k, c in jitter(latency).items()],
    )


def issue_since(latency: DataFrame, *, as_of: Column, lookback: str, bucket: str = "hour", loss_pct: float = 1.0) -> DataFrame:
    """Since when each link that is bad now has been bad without a break: after its last good bucket, or from its first bad one."""
    lost = is_lost(F.col("loss"), F.col("rtt_us"))
    hours = (
        latency.filter((F.col("event_ts") <= as_of) & (F.col("event_ts") > as_of - F.expr(f"INTERVAL {lookback}")))
        .groupBy("link_pk", F.date_trunc(bucket, "event_ts").alias("bucket"))
        .agg((F.count_if(lost) * 100.0 / F.count("*") >= loss_pct).alias("bad"))
    )
    found = hours.groupBy("link_pk").agg(
        F.max(F.when(~F.col("bad"), F.col("bucket"))).alias("last_good"), F.min(F.when(F.col("bad"), F.col("bucket"))).alias("first_bad"), F.max(F.when(F.col("bad"), F.col("bucket"))).alias("last_bad")
    )
    now_bad = F.col("last_bad").isNotNull() & (F.col("last_good").isNull() | (F.col("last_bad") > F.col("last_good")))
    return found.filter(now_bad).select("link_pk", F.coalesce(F.col("last_good") + F.expr(f"INTERVAL 1 {bucket}"), "first_bad").alias("since"))


def overlay_vs_other(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two networks by unordered pair (x, y, rtt_us, loss): mean, 95th percentile, loss, counts, and what the first saves."""

    def stats(df: DataFrame, name: str) -> DataFrame:
        lost = is_lost(F.col("loss"), F.col("rtt_us"))
        good = F.when(~lost, F.col("rtt_us"))
        return df.groupBy(F.least("x", "y").alias("metro1"), F.greatest("x", "y").alias("metro2")).agg(
            F.avg(good).alias(f"{name}_avg"), F.percentile(good, F.lit(0.95)).alias(f"{name}_p95"), (F.count_if(lost) * 100.0 / F.count("*")).alias(f"{name}_loss_pct"), F.count("*").alias(f"{name}_n"),
            *[c.alias(f"{name}_{k}") for k, c in jitter(df).items() if k == "avg_jitter_us"],
        )

    both = stats(a, "overlay").join(stats(b, "other"), ["metro1", "metro2"], "full")
    return both.withColumn("improvement_pct", ratio((F.col("other_avg") - F.col("overlay_avg")) * 100, F.col("other_avg")))


def comparison_summary(pairs: DataFrame) -> DataFrame:
    both = F.col("overlay_avg").isNotNull() & F.col("other_avg").isNotNull()
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.count_if(both).alias("n_both"), F.avg("improvement_pct").alias("avg_improvement_pct"), F.max("improvement_pct").alias("max_improvement_pct"), F.count_if(F.col("improvement_pct") > 0).alias("n_faster")
    )


def latency_series(latency: DataFrame, links: DataFrame, *, bucket: str, sub: str) -> DataFrame:
    """Per link and bucket: mean and 95th percentile, mean of each direction, and loss as the worst of its sub-buckets."""
    lost = is_lost(F.col("loss"), F.col("rtt_us"))
    good = F.when(~lost, F.col("rtt_us"))
    a_to_z = F.col("direction") == 0
    rows = latency.join(links.select("link_pk"), "link_pk", "left_semi").withColumn("bucket", F.date_trunc(bucket, "event_ts")).withColumn("sub", F.date_trunc(sub, "event_ts"))
    worst = rows.groupBy("link_pk", "bucket", "sub").agg((F.count_if(lost) * 100.0 / F.count("*")).alias("p")).groupBy("link_pk", "bucket").agg(F.max("p").alias("loss_pct"))
    stats = rows.groupBy("link_pk", "bucket").agg(
        F.avg(good).alias("avg_rtt_us"), F.percentile(good, F.lit(0.95)).alias("p95_rtt_us"), F.avg(F.when(a_to_z, good)).alias("a_to_z_us"), F.avg(F.when(~a_to_z, good)).alias("z_to_a_us"),
        *[c.alias(k) for k, c in jitter(rows).items()],
    )
    return stats.join(worst, ["link_pk", "bucket"])


def historical_loss(latency: DataFrame, *, grain: str, least_pct: float, metros: DataFrame | None = None) -> DataFrame:
    """Loss per link and bucket from least_pct on; or, with metros (link_pk, side_a, side_z), per pair of metros in either order."""
    lost, by = is_lost(F.col("loss"), F.col("rtt_us")), ["link_pk"]
    if metros is not None:
        pairs = metros.select("link_pk", F.least("side_a", "side_z").alias("metro1"), F.greatest("side_a", "side_z").alias("metro2"))
        latency, by = latency.join(pairs, "link_pk"), ["metro1", "metro2"]
    rows = latency.groupBy(*by, F.date_trunc(grain, "event_ts").alias("bucket")).agg((F.count_if(lost) * 100.0 / F.count("*")).alias("loss_pct"), F.count("*").alias("n"))
    return rows.filter(F.col("loss_pct") >= least_pct)


def links_now(health: DataFrame, links: DataFrame) -> DataFrame:
    """(link_pk, code, status, loss_pct, over_pct): what each link is now, from links_health(). over_pct: latency over what was promised."""
    own = links.select("link_pk", judged_rtt(links).alias("promised"))
    rows = health.drop("committed_rtt_us").join(own, "link_pk")
    state = (
        F.when(F.col("status") != "activated", "disabled").when(F.col("loss_pct").isNull(), "no_data").otherwise(classify_link(F.col("avg_rtt_us"), F.col("loss_pct"), F.col("promised")))
    )
    over = F.when(F.col("avg_rtt_us") > 0, ratio((F.col("avg_rtt_us") - F.col("promised")) * 100, F.col("promised")))
    return rows.select("link_pk", "code", state.alias("status"), "loss_pct", over.alias("over_pct"))


def network_status(links: DataFrame, devices: DataFrame, performance: DataFrame) -> DataFrame:
    """(kind, status, n, verdict): links and devices by state, and the verdict on the network.

    links, devices: (status). performance: one row with loss_pct, see network_performance(). More than a tenth of the links
    unhealthy, or a mean loss of LOSS_PCT's critical share, is unhealthy; more than a fifth degraded, any unhealthy, or its warning share is
    degraded. Links are counted first, then loss. All that is joined has one row.
    """
    n = [df.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "status", "n") for kind, df in (("link", links), ("device", devices))]
    part = lambda s: ratio(F.count_if(F.col("status") == s) * 100.0, F.count("*"))
    whole = links.agg(part("unhealthy").alias("bad"), part("degraded").alias("worn")).crossJoin(performance.select("loss_pct"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    verdict = (
        F.when(yes(F.col("bad") > VERDICT_PCT[0]), "unhealthy")
        .when(yes((F.col("worn") > VERDICT_PCT[1]) | (F.col("bad") > 0)), "degraded")
        .when(yes(F.col("loss_pct") >= LOSS_PCT[1]), "unhealthy")
        .when(yes(F.col("loss_pct") >= LOSS_PCT[0]), "degraded")
        .otherwise("healthy")
    )
    return n[0].unionByName(n[1]).crossJoin(F.broadcast(whole.select(verdict.alias("verdict"))))  # one row


def top_issues(now: DataFrame, limit: int = 10) -> DataFrame:
    """(link_pk, code, issue, value, threshold) of links_now(): losses and latencies over their first limit, the worst first."""
    live = now.filter("status <> 'disabled'")
    kinds = (("packet_loss", "loss_pct", LOSS_PCT[0]), ("high_latency", "over_pct", LATENCY_PCT[0]))
    feeds = [live.filter(F.col(c) >= least).select("link_pk", "code", F.lit(k).alias("issue"), F.col(c).alias("value"), F.lit(least).alias("threshold")) for k, c, least in kinds]
    return reduce(DataFrame.unionByName, feeds).orderBy(F.col("value").desc(), "link_pk", "issue").limit(limit)


def busiest_links(usage: DataFrame, limit: int = 10) -> DataFrame:
    """(link_pk, bucket, in_pct, out_pct, is_high) of link_usage(): the most used first; high from USED_PCT's warning on."""
    most = F.greatest(F.coalesce("in_pct", F.lit(0.0)), F.coalesce("out_pct", F.lit(0.0)))
    rows = usage.select("link_pk", "bucket", "in_pct", "out_pct", (most >= USED_PCT[0]).alias("is_high"), most.alias("most"))
    return rows.orderBy(F.col("most").desc(), "link_pk", "bucket").limit(limit).drop("most")


def non_activated(links: DataFrame, devices: DataFrame) -> DataFrame:
    """Links and devices that are not activated; an activated link with a delay override counts as soft-drained. since: see alerts_since()."""
    state = F.when((F.col("status") == "activated") & (F.col("delay_override_ns") > 0), "soft-drained").otherwise(F.col("status"))
    feeds = [
        links.select(F.lit("link").alias("kind"), F.col("link_pk").alias("pk"), "code", state.alias("status")),
        devices.select(F.lit("device").alias("kind"), F.col("device_pk").alias("pk"), "code", "status"),
    ]
    return reduce(DataFrame.unionByName, feeds).filter("status <> 'activated'")


def alerts_since(alerts: DataFrame, moves: DataFrame, limit: int | None = None) -> DataFrame:
    """non_activated() with since, the newest change of each one's status, the newest first. moves: (kind, pk, at), see scd2.status_transitions()."""
    newest = moves.groupBy("kind", "pk").agg(F.max("at").alias("since"))
    rows = alerts.join(newest, ["kind", "pk"], "left").orderBy(F.col("since").desc_nulls_last(), "kind", "pk")
    return rows if limit is None else rows.limit(limit)


def latency_history_pair(overlay: DataFrame, other: DataFrame, *, start: Column, end: Column, bucket: str, spark_frame: DataFrame) -> DataFrame:
    """A row for every bucket, with the means of both networks where they have samples. spark_frame: any frame of one row."""

    def means(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.window("event_ts", bucket)["start"].alias("bucket")).agg(F.avg("rtt_us").alias(name))

    every = spark_frame.select(spine(start, end, bucket).alias("bucket"))
    return every.join(means(overlay, "overlay_us"), "bucket", "left").join(means(other, "other_us"), "bucket", "left")
