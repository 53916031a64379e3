"""Queries on slowly-changing dimensions and their keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.keys import event_id, surrogate_key
from ..operators import scd2, state_table
from ..sources.shared import shared_dir
from .base import query, ts

LATEST = "row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts DESC, ingested_at DESC, op_id DESC)"


@query("SELECT c_custkey, sha256(strlen(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || strlen(c_name) || ':' || c_name) AS entity_id FROM customer")
def surrogate_keys(t):
    return t.customer.select("c_custkey", surrogate_key("c_custkey", "c_name").alias("entity_id"))


@query("SELECT event_id, substr(sha256(concat_ws('|', event_id, user_id, event_type)), 1, 16) AS id FROM events")
def event_ids(t):
    return t.events.select("event_id", event_id("event_id", "user_id", "event_type").alias("id"))


@query("SELECT count(*) AS n_entities, count(DISTINCT (status, priority, is_deleted)) AS n_states FROM history")
def attrs_hash_states(t):
    from ..functions.keys import attrs_hash

    rows = t.history.withColumn("h", attrs_hash("status", "priority", "is_deleted"))
    return rows.agg(F.count("*").alias("n_entities"), F.count_distinct("h").alias("n_states"))


@query(f"SELECT entity_id, snapshot_ts, op_id, status, priority FROM (SELECT *, {LATEST} AS n FROM history) WHERE n = 1 AND NOT is_deleted")
def current_state(t):
    return scd2.current_state(t.history).select("entity_id", "snapshot_ts", "op_id", "status", "priority")


@query(f"SELECT entity_id, snapshot_ts, op_id, status FROM (SELECT *, {LATEST} AS n FROM history WHERE snapshot_ts <= TIMESTAMP '1998-01-01') WHERE n = 1 AND NOT is_deleted")
def as_of_state(t):
    return scd2.as_of_state(t.history, ts("1998-01-01")).select("entity_id", "snapshot_ts", "op_id", "status")


CUT = """WITH old_rows AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts DESC, ingested_at DESC, op_id DESC) AS n FROM history WHERE snapshot_ts <= TIMESTAMP '1998-01-01'),
old_state AS (SELECT * FROM old_rows WHERE n = 1 AND NOT is_deleted),
new_rows AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY snapshot_ts DESC, ingested_at DESC, op_id DESC) AS n FROM history
  WHERE snapshot_ts > TIMESTAMP '1998-01-01' AND snapshot_ts <= TIMESTAMP '1998-07-01' AND NOT is_deleted),
new_state AS (SELECT * FROM new_rows WHERE n = 1)
"""


def _cut(t):
    h = t.history
    old = h.filter(F.col("snapshot_ts") <= ts("1998-01-01"))
    new = h.filter((F.col("snapshot_ts") > ts("1998-01-01")) & (F.col("snapshot_ts") <= ts("1998-07-01")) & ~F.col("is_deleted"))
    return old, new


DELTA_SQL = (
    CUT
    + """SELECT coalesce(n.entity_id, o.entity_id) AS entity_id,
  CASE WHEN n.entity_id IS NULL THEN 'deleted' WHEN o.entity_id IS NULL THEN 'created' ELSE 'updated' END AS change,
  coalesce(n.status, o.status) AS status, coalesce(n.priority, o.priority) AS priority, n.entity_id IS NULL AS is_deleted
FROM new_state n FULL JOIN old_state o ON n.entity_id = o.entity_id
WHERE n.entity_id IS NULL OR o.entity_id IS NULL OR n.status <> o.status OR n.priority <> o.priority"""
)


@query(DELTA_SQL)
def scd2_delta(t):
    old, new = _cut(t)
    rows = scd2.delta(old, new, ["status", "priority"], at=ts("1998-01-01"), op_id=F.lit(-1), missing_means_deleted=True)
    return rows.select("entity_id", "change", "status", "priority", "is_deleted")


@query(DELTA_SQL)
def scd2_delta_from_state(t):
    """As scd2_delta, from a snapshot of the first half of the history and the log since."""
    old, new = _cut(t)
    root, schema = f"{shared_dir(t.spark)}/state-{uuid.uuid4().hex}", "entity_id string, snapshot_ts timestamp, ingested_at timestamp, op_id long, status string, priority string, is_deleted boolean"
    rows = old.select("entity_id", "snapshot_ts", "ingested_at", "op_id", "status", "priority", "is_deleted")
    early = F.col("snapshot_ts") <= ts("1995-01-01")
    state_table.append(rows.filter(early), root, 0)
    state_table.compact(t.spark, root, schema)
    state_table.append(rows.filter(~early), root, 1)
    found = state_table.delta(t.spark, root, schema, new, ["status", "priority"], at=ts("1998-01-01"), op_id=F.lit(-1), missing_means_deleted=True)
    return found.select("entity_id", "change", "status", "priority", "is_deleted")


@query(CUT + "SELECT entity_id, snapshot_ts, op_id, status FROM new_state")
def scd2_staging_dedup(t):
    return scd2.dedup_snapshot(_cut(t)[1]).select("entity_id", "snapshot_ts", "op_id", "status")


@query(CUT + "SELECT o.entity_id, o.status, o.priority, true AS is_deleted FROM old_state o WHERE NOT EXISTS (SELECT 1 FROM new_state n WHERE n.entity_id = o.entity_id)")
def scd2_tombstones(t):
    old, new = _cut(t)
    return scd2.tombstones(old, new, at=ts("1998-01-01"), op_id=F.lit(-1)).select("entity_id", "status", "priority", "is_deleted")


@query(CUT + "SELECT entity_id, 'deleted' AS change, status FROM old_state")
def scd2_empty_snapshot(t):
    old, new = _cut(t)
    rows = scd2.delta(old, new.filter("false"), ["status"], at=ts("1998-01-01"), op_id=F.lit(-1), missing_means_deleted=True)
    return rows.select("entity_id", "change", "status")


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_new FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'")
def scd2_idempotent(t):
    old, new = _cut(t)
    again = scd2.delta(old.withColumn("op_id", F.lit(7)), new, ["status"], at=ts("1998-01-01"), op_id=F.lit(7))
    return old.agg(F.count("*").alias("n_rows")).crossJoin(again.agg(F.count("*").alias("n_new")))  # one row each


@query(
    """WITH lagged AS (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY snapshot_ts, ingested_at, op_id) AS previous FROM history)
SELECT entity_id, snapshot_ts AS at, op_id, previous, status AS new FROM lagged WHERE previous IS NOT NULL AND previous <> status"""
)
def status_transitions(t):
    return scd2.status_transitions(t.history)


@query(
    """WITH lagged AS (SELECT *, row_number() OVER w AS n, lag(is_deleted) OVER w AS was_deleted, lag(status) OVER w AS was_status, lag(priority) OVER w AS was_priority
  FROM history WINDOW w AS (PARTITION BY entity_id ORDER BY snapshot_ts, ingested_at, op_id)),
kinds AS (SELECT *, CASE WHEN is_deleted AND NOT coalesce(was_deleted, true) THEN 'deleted' WHEN NOT is_deleted AND n > 1 AND was_deleted THEN 'created'
  WHEN n = 1 AND NOT is_deleted THEN 'created' WHEN NOT is_deleted AND (status <> was_status OR priority <> was_priority) THEN 'updated' END AS change FROM lagged)
SELECT entity_id, snapshot_ts, op_id, change, status, priority,
  CASE WHEN change = 'updated' THEN CASE WHEN status <> was_status THEN 'status:' || was_status || '>' || status || ';' ELSE '' END ||
    CASE WHEN priority <> was_priority THEN 'priority:' || was_priority || '>' || priority || ';' ELSE '' END ELSE '' END AS fields
FROM kinds WHERE change IS NOT NULL AND snapshot_ts >= TIMESTAMP '1996-01-01' AND snapshot_ts < TIMESTAMP '1999-01-01'
  AND NOT (change = 'created' AND n = 1 AND snapshot_ts = (SELECT min(snapshot_ts) FROM history))"""
)
def change_log(t):
    log = scd2.change_log(t.history, ["status", "priority"], ts("1996-01-01"), ts("1999-01-01"))
    said = F.transform("changed_fields", lambda f: F.concat(f["field"], F.lit(":"), f["old"], F.lit(">"), f["new"], F.lit(";")))
    return log.withColumn("fields", F.array_join(said, "")).drop("changed_fields")


@query(
    """SELECT entity_id, date_trunc('month', snapshot_ts) AS bucket, arg_max(status, (snapshot_ts, op_id)) AS status FROM history GROUP BY ALL"""
)
def status_by_bucket(t):
    return scd2.status_by_bucket(t.history, "month")


@query(
    f"""WITH live AS (SELECT * FROM history WHERE NOT is_deleted),
seen AS (SELECT entity_id, min(snapshot_ts) AS first_ts, max(snapshot_ts) AS last_ts, arg_min(status, (snapshot_ts, op_id)) AS first_status, arg_max(status, (snapshot_ts, op_id)) AS last_status FROM live GROUP BY entity_id),
cur AS (SELECT entity_id FROM (SELECT *, {LATEST} AS n FROM history) WHERE n = 1 AND NOT is_deleted)
SELECT entity_id, 'joined' AS event, first_ts AS at, first_status AS status FROM seen WHERE first_ts >= TIMESTAMP '1995-06-01' AND first_ts < TIMESTAMP '2002-01-01'
UNION ALL SELECT entity_id, 'left', last_ts, last_status FROM seen WHERE last_ts >= TIMESTAMP '1995-06-01' AND last_ts < TIMESTAMP '2002-01-01' AND entity_id NOT IN (SELECT entity_id FROM cur)"""
)
def first_last_seen(t):
    return scd2.first_last_seen(t.history, scd2.current_state(t.history), ts("1995-06-01"), ts("2002-01-01"), ["status"])
