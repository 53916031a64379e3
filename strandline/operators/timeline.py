"""The event feed: changes, losses and interface trouble on one schema, filtered, grouped and counted.

Events: ts, category, kind, entity, severity, and the rest by feed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import typed_terms
from ..functions.numbers import clamped_sum, is_lost
from ..sources.shared import durable, settled


def packet_loss_events(latency: DataFrame, *, grain: str = "hour", least: int = 10, warn: float = 0.1, critical: float = 1.0) -> DataFrame:
    """Where a link's loss crosses the warning level from one bucket with samples to the next."""
    lost = is_lost(F.col("loss"), F.col("rtt_us"))
    pct = latency.groupBy("link_pk", F.date_trunc(grain, "event_ts").alias("ts")).agg((F.count_if(lost) * 100.0 / F.count("*")).alias("loss_pct"), F.count("*").alias("n")).filter(F.col("n") >= least)
    was = F.lag("loss_pct").over(Window.partitionBy("link_pk").orderBy("ts"))
    rows = pct.withColumn("was", was)
    kind = F.when((F.col("loss_pct") >= warn) & (F.coalesce("was", F.lit(0.0)) < warn), "packet_loss_started").when((F.col("loss_pct") < warn) & (F.col("was") >= warn), "packet_loss_recovered")
    severity = F.when(kind == "packet_loss_recovered", "success").when(F.col("loss_pct") >= critical, "critical").otherwise("warning")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("ts", "kind", F.col("link_pk").cast("string").alias("entity"), severity.alias("severity"), "loss_pct")


def interface_events(counters: DataFrame, *, grain: str, measures: tuple[str, ...] = ("errors", "discards", "carrier")) -> DataFrame:
    """Where a measure of an interface starts or stops from one bucket with rows to the next."""
    sums = counters.groupBy("device_pk", "intf", F.date_trunc(grain, "event_ts").alias("ts")).agg(*[clamped_sum(F.col(m)).alias(m) for m in measures])
    w = Window.partitionBy("device_pk", "intf").orderBy("ts")
    rows = sums.withColumns({f"was_{m}": F.lag(m).over(w) for m in measures})
    kinds = F.array_compact(
        F.array(*[F.when((F.col(m) > 0) & (F.coalesce(f"was_{m}", F.lit(0)) == 0), F.lit(f"{m}_started")).when((F.col(m) == 0) & (F.col(f"was_{m}") > 0), F.lit(f"{m}_stopped")) for m in measures])
    )
    return rows.select("ts", "device_pk", "intf", F.explode(kinds).alias("kind"))


def group_interface_events(events: DataFrame) -> DataFrame:
    """One event for all interfaces of a device with the same kind and time."""
    return events.groupBy("ts", "device_pk", "kind").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("intf")), ",").alias("interfaces"))


def change_events(log: DataFrame, category: str) -> DataFrame:
    """Entity changes as events; a deletion is a warning, a change of status to anything but activated too."""
    status = F.exists("changed_fields", lambda f: (f["field"] == "status") & (f["new"] != "activated"))
    severity = F.when((F.col("change") == "deleted") | status, "warning").otherwise("info")
    return log.select(F.col("snapshot_ts").alias("ts"), F.lit(category).alias("category"), F.concat_ws("_", F.lit(category), "change").alias("kind"), F.col("entity_id").alias("entity"), severity.alias("severity"), "op_id")


def node_events(moves: DataFrame) -> DataFrame:
    """Nodes that join or leave as events; those without stake are gossip nodes. moves: ts, entity, event ('joined' or 'left'), is_validator."""
    category = F.when(F.col("is_validator"), "validator").otherwise("gossip_node")
    return moves.select("ts", category.alias("category"), F.concat_ws("_", category, "event").alias("kind"), "entity", _gone(F.col("event") == "left").alias("severity"))


def account_events(seen: DataFrame) -> DataFrame:
    """Vote accounts first seen or gone for good as events. seen: entity_id, event, at."""
    return seen.select(F.col("at").alias("ts"), F.lit("vote_account").alias("category"), F.concat(F.lit("vote_account_"), "event").alias("kind"), F.col("entity_id").alias("entity"), _gone(F.col("event") == "left").alias("severity"))


def stake_events(changes: DataFrame) -> DataFrame:
    """Changes of stake as events; a decrease is a warning. changes: at, node, change."""
    less = F.col("change") < 0
    kind = F.when(less, "validator_stake_decreased").otherwise("validator_stake_increased")
    return changes.select(F.col("at").alias("ts"), F.lit("stake").alias("category"), kind.alias("kind"), F.col("node").cast("string").alias("entity"), _gone(less).alias("severity"))


def attribution_events(reasons: DataFrame) -> DataFrame:
    """What moved the connected total as events. reasons: t, node, kind, change."""
    return reasons.select(F.col("t").alias("ts"), F.lit("attribution").alias("category"), F.concat(F.lit("validator_"), "kind").alias("kind"), F.col("node").cast("string").alias("entity"), _gone(F.col("change") < 0).alias("severity"))


def trouble_events(grouped: DataFrame) -> DataFrame:
    """Grouped interface events of devices; what starts is a warning, what stops a success."""
    severity = F.when(F.col("kind").endswith("_started"), "warning").otherwise("success")
    return grouped.select("ts", F.lit("interface").alias("category"), F.concat(F.lit("interface_"), "kind").alias("kind"), F.col("device_pk").cast("string").alias("entity"), severity.alias("severity"))


def _gone(test: Column) -> Column:
    return F.when(test, "warning").otherwise("info")


# What each class of actions looks for in the kind of an event.
ACTIONS = {
    "added": ["_created", "_joined"],
    "removed": ["_deleted", "_left"],
    "changed": ["_updated", "_stake_changed"],
    "alerting": ["_started", "_stake_increased"],
    "resolved": ["_stopped", "_recovered", "_stake_decreased"],
}


def by_action(events: DataFrame, actions: list[str]) -> DataFrame:
    """Events of any of the classes of actions; unknown classes match nothing, no class matches all."""
    if not actions:
        return events
    parts = [p for a in actions for p in ACTIONS.get(a, [])]
    return events.filter(reduce(lambda c, p: c | F.contains("kind", F.lit(p)), parts, F.lit(False)))


def by_network(events: DataFrame, nodes: DataFrame, *, on: bool | None = None, least_stake: float = 0.0, categories: tuple[str, ...] = ("validator", "gossip_node")) -> DataFrame:
    """Events of nodes by connection and stake; events of other categories pass.

    nodes: (entity, stake, is_on), one row per node. Joining and leaving count as connected, whatever the node is now.
    on=None asks for both. Nodes that `nodes` lacks have no stake and are not connected.
    """
    rows = events.join(nodes.select("entity", F.col("stake").alias("node_stake"), F.col("is_on").alias("node_on")), "entity", "left")
    connected = F.coalesce("node_on", F.lit(False)) | F.col("kind").endswith("_joined") | F.col("kind").endswith("_left")
    wanted = F.coalesce("node_stake", F.lit(0.0)) >= least_stake
    if on is not None:
        wanted &= connected if on else ~connected
    return rows.filter(~F.col("category").isin(list(categories)) | wanted).select(*events.columns)


def dedup_events(events: DataFrame, keys: list[str], has: Column, tie: str) -> DataFrame:
    """One event per key; those for which `has` holds come first."""
    w = Window.partitionBy(*keys).orderBy(has.desc(), tie)
    return events.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def feed(events: list[DataFrame], *, start: Column | None = None, end: Column | None = None, categories: list[str] | None = None, severities: list[str] | None = None, entity: str | None = None) -> DataFrame:
    """All feeds on one schema, filtered."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)
    tests = [
        F.col("ts") >= start if start is not None else None, F.col("ts") < end if end is not None else None,
        F.col("category").isin(categories) if categories else None, F.col("severity").isin(severities) if severities else None, F.col("entity") == entity if entity else None,
    ]
    return reduce(lambda df, c: df if c is None else df.filter(c), tests, out)


def searched(terms: list[str]) -> Callable[[str, list[str]], Callable[[str], Column] | None]:
    """Which entities of a feed a search can find: a function of the feed's category and kinds that gives a condition, by the name of the
    column that has the entity; None where a term is found in the category or a kind, so that any entity may be. So a search goes to the histories before
    they are shuffled. Terms are those of typed_terms(), with the field 'entity'."""

    def of(category: str, kinds: list[str]) -> Callable[[str], Column] | None:
        plain = [x.lower() for x in terms if not x.startswith("entity:")]
        if any(x in said for x in plain for said in (category, *kinds)):
            return None
        return lambda column: typed_terms({"entity": column}, [column], terms)

    return of


def _counted(events: DataFrame) -> DataFrame:
    return events.groupBy("category", "kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_entities"), F.max("ts").alias("newest"))


def summary(feeds: list[DataFrame]) -> DataFrame:
    """(category, kind, severity, n, n_entities, newest) of all feeds. One feed is counted after the other, and its shuffle files are gone before
    the next is made, so disk holds those of one. Feeds that share a kind are counted together, else its entities would count twice."""
    rows = reduce(DataFrame.unionByName, [settled(_counted(f)) for f in feeds])
    if rows.count() > rows.select("category", "kind", "severity").distinct().count():  # a row a kind
        return _counted(feed(feeds))
    return rows


def with_id(events: DataFrame) -> DataFrame:
    """events with event_id: 16 hexadecimal digits of the SHA-256 of entity, time (RFC 3339, fraction without closing zeros) and kind."""
    fraction = F.rtrim(F.rtrim(F.date_format("ts", ".SSSSSS"), F.lit("0")), F.lit("."))
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
    return events.withColumn("event_id", F.substring(F.sha2(F.concat_ws(":", "entity", at, "kind"), 256), 1, 16))


def feed_page(feeds: list[tuple[DataFrame, Callable[[Column | None], DataFrame]]], limit: int, offset: int) -> DataFrame:
    """Rows offset to offset + limit of all feeds, the newest first, then by id.

    feeds: (newest, make) each. newest: one row and column, a time that no event of the feed is later than, null if none has a time;
    make(since): its events, of which those before since may be missing or wrong. Feeds are made in the order of their newest times, and
    the newest offset + limit rows kept. Once there are so many, earlier events than the last of them are not asked for, and feeds that end
    before it are not made at all (threshold algorithm; Fagin et al. 2001). So a page costs no sort of all events either.
    """
    order, n = [F.col("ts").desc(), "event_id", "category", "severity"], offset + limit
    ends = reduce(lambda a, b: a.unionByName(b), [newest.toDF("at").select(F.lit(k).alias("feed"), F.unix_micros(F.col("at").cast("timestamp")).alias("at")) for k, (newest, _) in enumerate(feeds)])
    known = sorted(((-math.inf if r.at is None else r.at, -r.feed) for r in ends.collect()), reverse=True)  # a row a feed
    since, heads = None, None
    for at, k in known:
        if since is not None and at < since:
            break
        start = None if since is None else F.timestamp_micros(F.lit(since))
        rows = feed([feeds[-k][1](start)], start=start)
        rows = with_id(rows.withColumn("ts", F.col("ts").cast("timestamp"))).orderBy(*order).limit(n)
        heads = durable(rows if heads is None else heads.unionByName(rows, allowMissingColumns=True).orderBy(*order).limit(n))
        count, last = heads.agg(F.count("ts"), F.min(F.unix_micros("ts"))).first()
        since = last if count == n else None
    return heads.orderBy(*order).offset(offset).limit(limit)


def histogram(events: DataFrame, *, start: Column, end: Column, bucket: str, one_row: DataFrame) -> DataFrame:
    """Events per bucket, zeros included. one_row: any frame of one row."""
    from .health import spine

    n = events.filter((F.col("ts") >= start) & (F.col("ts") < end)).groupBy(F.window("ts", bucket)["start"].alias("bucket")).agg(F.count("*").alias("n"))
    return one_row.select(spine(start, end, bucket).alias("bucket")).join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
