"""Outages: runs of lost samples, drained periods and gaps, and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_lost


def loss_buckets(latency: DataFrame, *, bucket: str = "5 minutes", least: int = 3, start: Column | None = None, end: Column | None = None, strict: bool = True) -> DataFrame:
    """(link_pk, bucket, loss_pct, n) of buckets with enough samples."""
    if start is not None:
        latency = latency.filter(F.col("event_ts") >= start)
    if end is not None:
        latency = latency.filter(F.col("event_ts") < end)
    lost = is_lost(F.col("loss"), F.col("rtt_us"), strict=strict)
    rows = latency.groupBy("link_pk", F.window("event_ts", bucket)["start"].alias("bucket"))
    return rows.agg((F.count_if(lost) * 100.0 / F.count("*")).alias("loss_pct"), F.count("*").alias("n")).filter(F.col("n") >= least)


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """rows with island, the number of its run of equal flags within the key."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag("flag").over(w).eqNullSafe(F.col("flag")), 0).otherwise(1)
    return rows.withColumn("flag", flag).withColumn("changed", changed).withColumn("island", F.sum("changed").over(w)).drop("changed")


def loss_outages(buckets: DataFrame, *, threshold: float = 10.0, least: int = 2, bucket: str = "5 minutes", severe: float = 10.0) -> DataFrame:
    """Runs of at least `least` buckets in a row above the threshold; they end with their last bucket."""
    runs = islands(buckets, ["link_pk"], "bucket", F.col("loss_pct") >= threshold).filter("flag")
    found = runs.groupBy("link_pk", "island").agg(F.min("bucket").alias("start_ts"), F.max("bucket").alias("last"), F.max("loss_pct").alias("peak"), F.count("*").alias("n_buckets"))
    return found.filter(F.col("n_buckets") >= least).select(
        "link_pk", "start_ts", (F.col("last") + F.expr(f"INTERVAL {bucket}")).alias("end_ts"), F.col("peak").alias("peak_loss_pct"), "n_buckets",
        F.when(F.col("peak") >= severe, "outage").otherwise("degraded").alias("severity"),
    )


def loss_ongoing(buckets: DataFrame, *, threshold: float, least: int = 2) -> DataFrame:
    """Links whose newest buckets, at least `least` in a row, are above the threshold; started with the first of that run."""
    runs = islands(buckets, ["link_pk"], "bucket", F.col("loss_pct") >= threshold)
    newest = runs.withColumn("top", F.max("island").over(Window.partitionBy("link_pk"))).filter("flag AND island = top")
    found = newest.groupBy("link_pk").agg(F.min("bucket").alias("start_ts"), F.max("loss_pct").alias("peak_loss_pct"), F.count("*").alias("n_buckets"))
    return found.filter(F.col("n_buckets") >= least)


def coalesce_outages(outages: DataFrame, *, keys: tuple[str, ...] = ("link_pk",), gap: str = "15 MINUTES") -> DataFrame:
    """Outages (keys, start_ts, end_ts or null if ongoing, peak) closer than the gap become one; an ongoing one absorbs all later ones."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts").rowsBetween(Window.unboundedPreceding, -1)
    never = F.to_timestamp(F.lit("9999-12-31"))
    rows = outages.withColumn("until", F.coalesce("end_ts", never))
    rows = rows.withColumn("reach", F.max("until").over(w))
    apart = F.col("reach").isNull() | ((F.col("reach") < never) & (F.col("start_ts") >= F.col("reach") + F.expr(f"INTERVAL {gap}")))
    rows = rows.withColumn("first", F.when(apart, 1).otherwise(0))
    rows = rows.withColumn("merged", F.sum("first").over(Window.partitionBy(*keys).orderBy("start_ts", "end_ts").rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy(*keys, "merged").agg(F.min("start_ts").alias("start_ts"), F.max("until").alias("until"), F.max("peak").alias("peak"), F.count("*").alias("n_merged"))
    return found.select(*keys, "start_ts", F.when(F.col("until") < never, F.col("until")).alias("end_ts"), "peak", "n_merged")


def status_outages(history: DataFrame, *, up: str = "activated") -> DataFrame:
    """Periods from leaving `up` to the next return, open-ended if there is none yet; harder states within one period don't cut it."""
    w = Window.partitionBy("entity_id").orderBy("snapshot_ts", "op_id")
    rows = history.withColumn("down", (F.col("status") != up).cast("int")).withColumn("was", F.lag("down").over(w))
    # A session starts when an entity that was up goes down; rows before the first such change belong to none.
    rows = rows.withColumn("session", F.sum(F.when((F.col("down") == 1) & (F.col("was") == 0), 1).otherwise(0)).over(w))
    found = rows.filter("session > 0").groupBy("entity_id", "session").agg(
        F.min("snapshot_ts").alias("start_ts"),
        F.min(F.when(F.col("down") == 0, F.col("snapshot_ts"))).alias("end_ts"),
        F.max(F.when((F.col("down") == 1), F.col("status") == "hard-drained")).alias("hard"),
    )
    seconds = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6
    return found.select("entity_id", "start_ts", "end_ts", "hard", seconds.alias("seconds"))


def drained_periods(history: DataFrame, *, up: str = "activated") -> DataFrame:
    """(link_pk, start_ts, end_ts or null) of status_outages()."""
    return status_outages(history, up=up).select(F.col("entity_id").alias("link_pk"), "start_ts", "end_ts")


def drained_now(current: DataFrame, transitions: DataFrame, *, up: str = "activated") -> DataFrame:
    """Entities that are drained, since their last change away from `up` (null if they were never up)."""
    last = transitions.filter((F.col("previous") == up) & (F.col("new") != up)).groupBy("entity_id").agg(F.max("at").alias("since"))
    return current.filter(F.col("status") != up).join(last, "entity_id", "left").select("entity_id", "status", "since")


def no_data_gaps(latency: DataFrame, *, bucket: str = "5 minutes", gap: str = "15 minutes") -> DataFrame:
    """(link_pk, start_ts, end_ts): from the end of a bucket with samples to the next such bucket, if the gap is long enough."""
    seen = latency.groupBy("link_pk", F.window("event_ts", bucket)["start"].alias("bucket")).agg(F.count("*").alias("n"))
    following = F.lead("bucket").over(Window.partitionBy("link_pk").orderBy("bucket"))
    rows = seen.withColumn("end_ts", following).withColumn("start_ts", F.col("bucket") + F.expr(f"INTERVAL {bucket}"))
    return rows.filter(F.col("end_ts") - F.col("bucket") >= F.expr(f"INTERVAL {gap}")).select("link_pk", "start_ts", "end_ts")


def no_data_now(latency: DataFrame, drained: DataFrame, *, as_of: Column, after: str = "15 MINUTES", within: str = "30 DAYS") -> DataFrame:
    """Links last seen a while ago that are not drained."""
    last = latency.filter(F.col("event_ts") <= as_of).groupBy("link_pk").agg(F.max("event_ts").alias("last_seen"))
    silent = last.filter((F.col("last_seen") <= as_of - F.expr(f"INTERVAL {after}")) & (F.col("last_seen") >= as_of - F.expr(f"INTERVAL {within}")))
    return silent.join(drained.select("link_pk"), "link_pk", "left_anti")


def outage_report(*feeds: DataFrame) -> DataFrame:
    """All outages (kind, link_pk, start_ts, end_ts, severity), newest first when sorted by the caller."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("ongoing", F.col("end_ts").isNull())


def for_items(report: DataFrame, links: DataFrame, *, metro: int | None = None, link: int | None = None, contributor: int | None = None, device: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The report with each link's code, for links of a metro, link, contributor or device; all filters that are given hold.

    links: link_pk, code, side_a, side_z, contributor_pk. ends: (link_pk, device_pk), the devices of links, asked for by `device` alone.
    """
    if metro is not None:
        links = links.filter((F.col("side_a") == metro) | (F.col("side_z") == metro))
    if link is not None:
        links = links.filter(F.col("link_pk") == link)
    if contributor is not None:
        links = links.filter(F.col("contributor_pk") == contributor)
    if device is not None:
        links = links.join(ends.filter(F.col("device_pk") == device).select("link_pk").distinct(), "link_pk", "left_semi")
    return report.join(links.select("link_pk", "code"), "link_pk").select("kind", "link_pk", "code", "start_ts", "end_ts", "ongoing")


def outage_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ongoing").alias("n_ongoing"), F.count_distinct("link_pk").alias("n_links"))
