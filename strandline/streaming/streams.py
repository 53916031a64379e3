"""Structured Streaming: dedup, windows, sessions, state per key, and history from snapshots."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import durable, shared_dir


def read_stream(spark: SparkSession, folder: str, file: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder that match a pattern."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, *, mode: str = "append", root: str | None = None) -> DataFrame:
    """All rows that a stream has given for the data there was till now, through a Parquet table in the shared folder. With the root of
    an earlier run, the stream goes on from its checkpoint, with its state."""
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        # Each batch has all rows (complete) or what changed (update): batches are tables of their own.
        write = lambda df, n: df.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/batch={n}")
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out") if mode == "append" else spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").drop("batch")


def newest_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written by several batches, those of the last batch that has their key."""
    rest = [c for c in df.columns if c not in keys and c != "__batch"]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("row")).select(*keys, "row.*")


def dedup(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once, among rows that come within the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, ts: str, delay: str, bucket: str, key: str) -> DataFrame:
    """Loss per key and bucket."""
    rows = stream.withWatermark(ts, delay).groupBy(F.window(ts, bucket)["start"].alias("bucket"), key)
    return rows.agg((F.count_if("loss") * 100.0 / F.count("*")).alias("loss_pct"), F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, delay: str, gap: str, key: str) -> DataFrame:
    """Runs of rows of a key closer than the gap; they end with the gap after their last row."""
    rows = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def _previous(key: str, order: list[str], value: str):
    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The rows of one key in a batch, in order, each with the last kept value before it; the key's own state goes on from there."""
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)
        watermark = state.getCurrentWatermarkMs()
        last, seen = state.get if state.exists else (None, -1)
        if seen < watermark:
            last = None  # run out, though rows came before the timeout did
        kept = rows[value].where(rows["__keep"]).ffill()
        previous = kept.shift(1)
        if last is not None:
            previous = previous.fillna(last)
        yield rows[[key, *order, value]].assign(previous=previous)
        now = kept.iloc[-1]
        last = float(now) if pd.notna(now) else last
        newest = int(rows["__seen"].max())
        state.update((last, max(seen, newest)))
        state.setTimeoutTimestamp(max(seen, newest, watermark + 1))

    return run


def with_previous(stream: DataFrame, key: str, order: list[str], value: str, keep: Column, *, ts: str, ttl: str, root: str) -> DataFrame:
    """(key, order, value, previous): the value of the key's last row before this one for which keep holds, over all batches.

    State is one value and one time for each key, in the stream's state store, of which a batch reads and writes its own keys alone. A key
    of which nothing came for `ttl` runs out, by the watermark of ts. Rows of a batch are sorted by order; rows that come in a
    later batch than their successors see the newer state, and belong to the backfill; rows older than `ttl` before the newest are
    dropped. A task holds the rows of one key in one batch, which files_per_batch bounds. key must not be null.
    """
    kinds = dict(stream.dtypes)
    rows = stream.withWatermark(ts, ttl).select(
        key, *order, *[c for c in (ts,) if c not in order], F.col(value).cast("double").alias(value), F.coalesce(keep, F.lit(False)).alias("__keep"), F.unix_millis(ts).alias("__seen")
    )
    out = ", ".join([f"{key} {kinds[key]}", *[f"{c} {kinds[c]}" for c in order], f"{value} double", "previous double"])
    found = rows.filter(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(_previous(key, order, value), out, "last double, seen long", "append", GroupStateTimeout.EventTimeTimeout)
    return run_available(found, root=root)


def apply_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], *, root: str | None = None) -> None:
    """Call step(batch, number) for each micro-batch of the data there is now; number serves as an op_id, which makes a repeat harmless."""
    root = root or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(step).option("checkpointLocation", root).trigger(availableNow=True).start().awaitTermination()


def arrival_blocks(rows: DataFrame, arrival: str, block_rows: int) -> DataFrame:
    """rows with a block number that rises with arrival; blocks have about block_rows rows, whatever the unit of arrival."""
    known = rows.filter(F.col(arrival).isNotNull())
    n = max(1, math.ceil(known.count() / block_rows))
    return durable(known.repartitionByRange(n, arrival).withColumn("block", F.spark_partition_id()))


def late_rows(rows: DataFrame, ts: str, arrival: str, delay: str, block_rows: int = 100_000) -> DataFrame:
    """Rows older than the watermark when they come: the newest time among earlier arrivals, less the delay.

    A batch query over arrivals, which finds what the stream has dropped and the backfill must derive again.
    """
    # Arrivals are cut into blocks, so that no task holds them all: a running maximum within blocks, and one over blocks.
    blocks = arrival_blocks(rows, arrival, block_rows)
    tops = blocks.groupBy("block").agg(F.max(ts).alias("top"))
    tops = tops.withColumn("earlier", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inside = F.max(ts).over(Window.partitionBy("block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    seen = blocks.withColumn("inside", inside).join(tops, "block").withColumn("newest", F.greatest("inside", "earlier"))
    return seen.filter(F.col(ts) < F.col("newest") - F.expr(f"INTERVAL {delay}")).drop("block", "inside", "earlier")
