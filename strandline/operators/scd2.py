"""Slowly-changing dimensions of type 2: one row per change, current and past states computed on read.

History columns: entity_id, snapshot_ts, ingested_at, op_id, is_deleted, attrs_hash, and attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import attrs_hash

VERSION = ("snapshot_ts", "ingested_at", "op_id")


def latest(history: DataFrame, key: str = "entity_id", version: tuple[str, ...] = VERSION) -> DataFrame:
    """The newest version of each entity, deleted or not. An aggregate, so hot entities shrink before the shuffle."""
    row = F.struct(*[F.col(c) for c in history.columns if c != key])
    return history.groupBy(key).agg(F.max_by(row, F.struct(*version)).alias("row")).select(key, "row.*").select(*history.columns)


def current_state(history: DataFrame, ids: DataFrame | None = None, key: str = "entity_id", version: tuple[str, ...] = VERSION) -> DataFrame:
    """Newest versions that are not deleted; a tombstone hides its entity. ids limits the entities."""
    if ids is not None:
        history = history.join(ids.select(key).distinct(), key, "left_semi")
    return latest(history, key, version).filter(~F.col("is_deleted"))


def as_of_state(history: DataFrame, at: Column, ids: DataFrame | None = None, key: str = "entity_id") -> DataFrame:
    """current_state() as it was at a time."""
    return current_state(history.filter(F.col("snapshot_ts") <= at), ids, key)


def dedup_snapshot(snapshot: DataFrame, key: str = "entity_id") -> DataFrame:
    """One row per entity of a snapshot: the one with the highest version."""
    return latest(snapshot, key)


def delta(history: DataFrame, snapshot: DataFrame, attrs: list[str], *, at: Column, op_id: Column, missing_means_deleted: bool = False) -> DataFrame:
    """Rows to append to history after a snapshot (entity_id, version, attrs): new and changed entities, and tombstones.

    A tombstone keeps the attributes. A snapshot whose op_id is in history already gives nothing, and an empty
    snapshot gives tombstones for all, if missing means deleted. One full join; entities meet once.
    """
    seen = history.withColumn("same_op", F.coalesce(F.col("op_id").cast("string") == op_id.cast("string"), F.lit(False)))
    done = seen.agg(F.coalesce(F.max("same_op"), F.lit(False)).alias("done"))
    old = latest(history.filter(F.col("snapshot_ts") <= at)).filter(~F.col("is_deleted"))
    new = dedup_snapshot(snapshot)
    old_side = old.select(F.col("entity_id"), F.struct(*[F.col(a) for a in attrs]).alias("old"), attrs_hash(*attrs).alias("old_hash"))
    new_side = new.select(F.col("entity_id"), F.struct(*[F.col(a) for a in attrs]).alias("new"), attrs_hash(*attrs).alias("new_hash"))
    both = new_side.join(old_side, "entity_id", "full")
    change = (
        F.when(F.col("new").isNull(), "deleted" if missing_means_deleted else None)
        .when(F.col("old").isNull(), "created")
        .when(F.col("new_hash") != F.col("old_hash"), "updated")
    )
    rows = both.withColumn("change", change).filter("change IS NOT NULL").crossJoin(F.broadcast(done)).filter(~F.col("done"))  # one row
    return rows.select(
        "entity_id",
        at.alias("snapshot_ts"),
        op_id.alias("op_id"),
        (F.col("change") == "deleted").alias("is_deleted"),
        "change",
        *[F.when(F.col("change") == "deleted", F.col(f"old.{a}")).otherwise(F.col(f"new.{a}")).alias(a) for a in attrs],
    )


def tombstones(history: DataFrame, snapshot: DataFrame, *, at: Column, op_id: Column) -> DataFrame:
    """Active entities that a snapshot no longer has, as deleted versions."""
    gone = latest(history.filter(F.col("snapshot_ts") <= at)).filter(~F.col("is_deleted")).join(snapshot.select("entity_id"), "entity_id", "left_anti")
    return gone.withColumns({"snapshot_ts": at, "op_id": op_id, "is_deleted": F.lit(True)})


def _by_entity() -> Window:
    return Window.partitionBy("entity_id").orderBy(*VERSION)


def status_transitions(history: DataFrame, status: str = "status") -> DataFrame:
    """(entity_id, at, previous, new) wherever the status changes; an entity's first row is no change."""
    rows = history.withColumn("previous", F.lag(status).over(_by_entity()))
    rows = rows.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))
    return rows.select("entity_id", F.col("snapshot_ts").alias("at"), "op_id", "previous", F.col(status).alias("new"))


def change_log(history: DataFrame, attrs: list[str], start: Column, end: Column, of: Column | None = None) -> DataFrame:
    """created, updated and deleted versions in [start, end), each with the fields that changed.

    Entities of the very first ingestion are not 'created'. All lags share one window, so there is one sort. of: a condition on entity_id,
    if not all entities are asked for; the first ingestion is that of all.
    """
    w = _by_entity()
    first = history.agg(F.min("snapshot_ts").alias("ingestion_start"))
    rows = (history if of is None else history.filter(of)).withColumn("h", attrs_hash(*attrs))
    rows = rows.withColumns({"n": F.row_number().over(w), "was_deleted": F.lag("is_deleted").over(w), "was_h": F.lag("h").over(w)} | {f"was_{a}": F.lag(a).over(w) for a in attrs})
    kind = (
        F.when(F.col("is_deleted") & ~F.coalesce("was_deleted", F.lit(True)), "deleted")
        .when(~F.col("is_deleted") & (F.col("n") > 1) & F.col("was_deleted"), "created")
        .when((F.col("n") == 1) & ~F.col("is_deleted"), "created")
        .when(~F.col("is_deleted") & (F.col("h") != F.col("was_h")), "updated")
    )
    diffs = F.array(*[F.struct(F.lit(a).alias("field"), F.col(f"was_{a}").cast("string").alias("old"), F.col(a).cast("string").alias("new")) for a in attrs])
    changed = F.filter(diffs, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return (
        rows.crossJoin(F.broadcast(first))  # one row
        .withColumn("change", kind)
        .filter(F.col("change").isNotNull() & (F.col("snapshot_ts") >= start) & (F.col("snapshot_ts") < end))
        .filter(~((F.col("change") == "created") & (F.col("n") == 1) & (F.col("snapshot_ts") == F.col("ingestion_start"))))
        .withColumn("changed_fields", F.when(F.col("change") == "updated", changed).otherwise(F.array().cast("array<struct<field:string,old:string,new:string>>")))
        .select("entity_id", "snapshot_ts", "op_id", "change", *attrs, "changed_fields")
    )


def status_by_bucket(history: DataFrame, bucket: str, status: str = "status") -> DataFrame:
    """The last status of each entity inside each time bucket (hour, day, month, ...) that has a version."""
    return (
        history.withColumn("bucket", F.date_trunc(bucket, "snapshot_ts"))
        .groupBy("entity_id", "bucket")
        .agg(F.max_by(status, F.struct(*VERSION)).alias(status))
    )


def first_last_seen(history: DataFrame, current: DataFrame, start: Column, end: Column, attrs: list[str]) -> DataFrame:
    """Entities that joined (first seen in [start, end)) or left (last seen there and not current), with attributes at that moment."""
    live = history.filter(~F.col("is_deleted"))
    row = F.struct(*attrs)
    seen = live.groupBy("entity_id").agg(
        F.min("snapshot_ts").alias("first_ts"),
        F.max("snapshot_ts").alias("last_ts"),
        F.min_by(row, F.struct(*VERSION)).alias("first"),
        F.max_by(row, F.struct(*VERSION)).alias("last"),
    )
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    joined = seen.filter(inside("first_ts")).select("entity_id", F.lit("joined").alias("event"), F.col("first_ts").alias("at"), "first.*")
    left = seen.filter(inside("last_ts")).join(current.select("entity_id"), "entity_id", "left_anti")
    return joined.unionByName(left.select("entity_id", F.lit("left").alias("event"), F.col("last_ts").alias("at"), "last.*"))
