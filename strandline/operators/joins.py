"""Joins that Spark has no operator for."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable
from .intervals import overlapping


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], tie: list[str] | None = None, tolerance_seconds: int | None = None, part_rows: int = 200_000
) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time.

    The rows of both sides are cut by key and time into parts of about part_rows, whose numbers are kept before they are used twice. Within a
    part a window carries the last right row forward; the last one of a key's earlier parts comes from a table with one row a key and
    part. So a key with a third of all rows is spread over its parts. Rights at the same time count, the last by `tie`. Left rows without
    a match, or with one older than the tolerance, get nulls; null keys are a key like any other.
    """
    r = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(F.col(right_ts).alias("at"), *values).alias("__right"), F.struct(*(tie or values)).alias("__tie"))
    l = left.select(*by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))  # noqa: E741
    rows = durable(l.unionByName(r, allowMissingColumns=True))
    parts, place = max(1, math.ceil(rows.count() / part_rows)), ["__ts", "__side", "__tie"]
    if parts > 1:
        rows = durable(rows.repartitionByRange(parts, *by, *place).withColumn("__part", F.spark_partition_id()))
    else:
        rows = rows.withColumn("__part", F.lit(0))
    w = Window.partitionBy("__part", *by).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("__found", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    if parts > 1:
        # Structs compare with nulls in them, so that a null key finds its earlier parts too.
        ends = rows.filter("__side = 0").groupBy("__part", F.struct(*by).alias("__key")).agg(F.max_by("__right", F.struct("__ts", "__tie")).alias("__end"))
        lists = rows.select("__part", F.struct(*by).alias("__key")).distinct().join(ends, ["__part", "__key"], "left")
        before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        carried = lists.select("__part", "__key", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
        found = found.withColumn("__key", F.struct(*by)).join(carried, ["__part", "__key"], "left").withColumn("__found", F.coalesce("__found", "__carry"))
    if tolerance_seconds is not None:
        fresh = F.unix_micros("__ts") - F.unix_micros("__found.at") <= tolerance_seconds * 1_000_000
        found = found.withColumn("__found", F.when(fresh, F.col("__found")))
    return found.select("__left.*", F.col("__found.at").alias(f"matched_{right_ts}"), *[F.col(f"__found.{v}").alias(v) for v in values])


def overlap_anti(gaps: DataFrame, periods: DataFrame, by: list[str]) -> DataFrame:
    """Gaps (by, start_ts, end_ts) that overlap no period (by, start_ts, end_ts or null if open) of their key. Both meet in cells of
    time, so a key with many gaps and periods is not compared all with all."""
    own, span = [*by, "start_ts", "end_ts"], ("start_ts", "end_ts")
    met = overlapping(gaps.select(*own).distinct(), periods.select(*own).distinct(), by, a_span=span, b_span=span)
    return gaps.join(met.select(*by, "a.start_ts", "a.end_ts").distinct(), own, "left_anti")


def with_fallback(rows: DataFrame, direct: DataFrame, key: str, parent: Column, value: str) -> DataFrame:
    """value of the row's key or, where there is none, of its parent key."""
    own = direct.select(F.col(key), F.col(value).alias("own_value"))
    up = direct.select(F.col(key).alias("parent_key"), F.col(value).alias("parent_value"))
    joined = rows.withColumn("parent_key", parent).join(own, key, "left").join(up, "parent_key", "left")
    return joined.withColumn(value, F.coalesce("own_value", "parent_value")).drop("own_value", "parent_value", "parent_key")


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges [low, high] that hold them: an equi-join on cells of the given width, then the exact test.

    A range is copied to each cell that it touches, so width should be near the usual range."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("__cell", F.floor(F.col(point) / width)).join(cells, "__cell").filter(F.col(point).between(F.col(low), F.col(high))).drop("__cell")


def ip_to_long(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    p = F.split(F.regexp_extract(ip, r"^(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1), r"\.")
    return F.when(F.size(p) == 4, sum((p[i].try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), p[0].try_cast("long") * 256**3))


def cidr_pair(net: Column) -> Column:
    """The two addresses of a /31 network, as an array of numbers; null for other networks."""
    base = ip_to_long(F.split_part(net, F.lit("/"), F.lit(1)))
    return F.when(net.endswith("/31"), F.array(base, base + 1))


def cidr_range(net: Column) -> Column:
    """(low, high) of a network in CIDR notation, as numbers."""
    size = F.pow(F.lit(2), 32 - F.split_part(net, F.lit("/"), F.lit(2)).try_cast("int")).cast("long")
    base = ip_to_long(F.split_part(net, F.lit("/"), F.lit(1)))
    low = base - F.pmod(base, size)
    return F.struct(low.alias("low"), (low + size - 1).alias("high"))


def either_side(a: str, z: str, value) -> Column:
    return (F.col(a) == value) | (F.col(z) == value)


def latest_rows(rows: DataFrame, key: str, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
