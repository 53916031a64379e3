"""Facts: append-only time series, and what is derived from the previous rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def get_rows(facts: DataFrame, *, start: Column | None = None, end: Column | None = None, where: Column | None = None, order_by: list | None = None, limit: int | None = None, ts: str = "event_ts") -> DataFrame:
    """Rows of [start, end) that match; newest first unless told otherwise."""
    for cond in (F.col(ts) >= start if start is not None else None, F.col(ts) < end if end is not None else None, where):
        if cond is not None:
            facts = facts.filter(cond)
    facts = facts.orderBy(*(order_by or [F.col(ts).desc()]))
    return facts if limit is None else facts.limit(limit)


def append(facts: DataFrame, path: str, schema_of: DataFrame | None = None, partition: str = "event_ts", most_rows: int = 50_000) -> None:
    """Append to a table partitioned by month, after checking that the columns are those of the table."""
    if schema_of is not None and sorted(facts.columns) != sorted(schema_of.columns):
        raise ValueError(f"columns differ: {sorted(set(facts.columns) ^ set(schema_of.columns))}")
    month = facts.withColumn("month", F.date_format(partition, "yyyy-MM"))
    month.write.mode("append").partitionBy("month").option("maxRecordsPerFile", most_rows).parquet(path)


def dedup_latest(facts: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row per key, the one with the highest version."""
    rest = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("row"))
    return best.select(*keys, "row.*").select(*facts.columns)


def boundaries(facts: DataFrame, ts: str = "event_ts", epoch: str | None = None) -> DataFrame:
    """First and last time, rows, and first and last epoch if there is one."""
    aggs = [F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count("*").alias("n_rows")]
    if epoch:
        aggs += [F.min(epoch).alias("min_epoch"), F.max(epoch).alias("max_epoch")]
    return facts.agg(*aggs)


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def counter_deltas(raw: DataFrame, keys: list[str], order: list[str], counters: list[str], ts: str = "event_ts", sparse: tuple[str, ...] = (), baselines: DataFrame | None = None) -> DataFrame:
    """Cumulative counters as differences from the last known value of their key, past nulls; with delta_seconds since the previous row.

    Without a baseline a key's first row is one for the others and gives no row, unless all its counters are sparse.
    baselines: (keys, counters), the last known values before these rows.
    """
    w = _before(keys, order)
    known = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = raw
    if baselines is not None:
        rows = rows.join(baselines.select(*keys, *[F.col(c).alias(f"base_{c}") for c in counters], F.lit(True).alias("has_base")), keys, "left")
    else:
        rows = rows.withColumns({f"base_{c}": F.lit(None).cast(raw.schema[c].dataType) for c in counters} | {"has_base": F.lit(None).cast("boolean")})
    out = rows.withColumns(
        {f"{c}_delta": F.col(c) - F.coalesce(F.last(c, ignorenulls=True).over(known), F.col(f"base_{c}")) for c in counters}
        | {"delta_seconds": (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6, "row_n": F.row_number().over(w)}
    )
    if set(counters) - set(sparse):
        out = out.filter((F.col("row_n") > 1) | F.coalesce("has_base", F.lit(False)))
    return out.drop("row_n", "has_base", *[f"base_{c}" for c in counters])


def counter_baselines(facts: DataFrame, keys: list[str], counters: list[str], start: Column, lookback: str, ts: str = "event_ts") -> DataFrame:
    """The last non-null value of each counter and key in the lookback before start; one pass."""
    window = facts.filter((F.col(ts) < start) & (F.col(ts) >= start - F.expr(f"INTERVAL {lookback}")))
    return window.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in counters])


def ipdv(samples: DataFrame, circuit: list[str], order: list[str], rtt: str = "rtt_us") -> DataFrame:
    """Jitter: the difference from the circuit's previous sample that was not lost. Null on loss and on the first; a round trip of 0 is a loss."""
    good = F.when(F.col(rtt) > 0, F.col(rtt))
    last = F.last(good, ignorenulls=True).over(_before(circuit, order).rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("ipdv_us", F.abs(good - last)).withColumn("loss", F.col(rtt) == 0)


def previous_value(facts: DataFrame, keys: list[str], order: list[str], rtt: str = "rtt_us") -> DataFrame:
    """The last round trip of each circuit that was not lost."""
    return facts.filter(F.col(rtt) > 0).groupBy(*keys).agg(F.max_by(rtt, F.struct(*order)).alias(rtt))


def max_index(facts: DataFrame, keys: list[str], index: str = "sample_index") -> DataFrame:
    return facts.groupBy(*keys).agg(F.max(index).alias("max_index"))


def incremental_append(new: DataFrame, existing: DataFrame, keys: list[str], index: str = "sample_index") -> DataFrame:
    """Rows of new past the largest index that exists for their keys."""
    top = max_index(existing, keys, index)
    return new.join(top, keys, "left").filter(F.col("max_index").isNull() | (F.col(index) > F.col("max_index"))).drop("max_index")


def skip_written(new: DataFrame, existing: DataFrame, keys: list[str], ts: str = "event_ts") -> DataFrame:
    """Rows of new after the newest that exists for their keys."""
    return incremental_append(new, existing, keys, ts)


def overlap_start(facts: DataFrame, now: Column, overlap: str = "5 MINUTES", window: str = "1 HOUR", ts: str = "event_ts") -> DataFrame:
    """Where the next read starts: a little before the newest row, or a window before now for an empty table."""
    return facts.agg(F.coalesce(F.max(ts) - F.expr(f"INTERVAL {overlap}"), now - F.expr(f"INTERVAL {window}")).alias("read_from"))


def unordered_pairs(rows: DataFrame, code: str) -> DataFrame:
    """Every pair of distinct codes once, smaller first; for small dimension tables."""
    codes = rows.select(code).distinct()
    return codes.select(F.col(code).alias("origin")).join(codes.select(F.col(code).alias("target")), F.col("origin") < F.col("target"))


def credits_delta(activity: DataFrame, key: str, order: str, epoch: str, credits: str) -> DataFrame:
    """Credits gained since the account's previous row: at least 0 within an epoch; null across epochs and on the first row."""
    w = Window.partitionBy(key).orderBy(order)
    same = F.lag(epoch).over(w) == F.col(epoch)
    return activity.withColumn("credits_delta", F.when(same, F.greatest(F.col(credits) - F.lag(credits).over(w), F.lit(0))))


def tunnel_id(interface: Column) -> Column:
    """The number of an interface like Tunnel123."""
    return F.regexp_extract(interface, r"^(?i:tunnel)(\d+)$", 1).try_cast("long")


def interface_links(links: DataFrame) -> DataFrame:
    """(device, interface, link_pk, side) of both sides of each link."""
    side = lambda s, name: links.select(F.col(f"side_{s}_pk").alias("device"), F.col(f"side_{s}_iface").alias("interface"), "link_pk", F.lit(name).alias("side"))
    return side("a", "A").unionByName(side("z", "Z")).filter("interface <> ''")


def backfill(derive, facts: DataFrame, start: Column, end: Column, path: str, ts: str = "event_ts") -> None:
    """Derive [start, end) again and overwrite just its days."""
    rows = derive(facts.filter((F.col(ts) >= start) & (F.col(ts) < end))).withColumn("day", F.to_date(ts))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
