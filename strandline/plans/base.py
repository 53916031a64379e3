"""How queries are registered, and the driver's tables in the roles that operators expect.

Each view is portable SQL over other views or tables, named in braces. Spark runs it to make an operator's input;
the oracle gets the same text as a CTE, so both sides start from the same rows and differ in everything after.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    # orders as the history of customers: one version per order
    "history": """SELECT CAST(o_custkey AS STRING) AS entity_id, o_orderdate AS snapshot_ts, o_orderdate AS ingested_at, o_orderkey AS op_id,
        CASE o_orderstatus WHEN 'O' THEN 'activated' WHEN 'P' THEN 'soft-drained' ELSE 'hard-drained' END AS status,
        o_orderpriority AS priority, o_orderstatus = 'F' AS is_deleted FROM {orders}""",
    # events as latency samples of links
    "latency": """SELECT ts AS event_ts, user_id AS link_pk, event_id AS sample_index, CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE value END AS rtt_us,
        event_type = 'error' AS loss, event_id % 2 AS direction FROM {events}""",
    # the same with the change from the link's sample before, where both came through
    "jittered": """SELECT *, CASE WHEN rtt_us > 0 AND NOT loss AND was > 0 THEN abs(rtt_us - was) END AS ipdv_us
        FROM (SELECT *, lag(rtt_us) OVER (PARTITION BY link_pk ORDER BY event_ts, sample_index) AS was FROM {latency}) j""",
    # customers as links: nation and region of both sides, what was promised and whether they are drained
    "links": """SELECT c_custkey AS link_pk, c_name AS code, c_nationkey AS side_a, CAST((c_nationkey + c_custkey) % 25 AS INT) AS side_z,
        CAST(100 + c_custkey % 150 AS DOUBLE) AS committed_rtt_us, CAST(1000 * (1 + c_custkey % 10) AS DOUBLE) AS bandwidth_bps,
        CASE WHEN c_custkey % 17 = 0 THEN 'soft-drained' WHEN c_custkey % 23 = 0 THEN 'hard-drained' ELSE 'activated' END AS status,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'WAN' ELSE 'LOCAL' END AS link_type, CAST(CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END AS BIGINT) AS delay_override_ns,
        c_custkey % 5 AS contributor_pk FROM {customer}""",
    "metros": "SELECT n_nationkey AS metro_pk, n_name AS code, n_regionkey AS region_pk FROM {nation}",
    "devices": "SELECT s_suppkey AS device_pk, s_name AS code, s_nationkey AS metro_pk, CAST(8 + s_suppkey % 40 AS INT) AS max_users, CASE WHEN s_suppkey % 13 = 0 THEN 'drained' ELSE 'activated' END AS status, s_suppkey % 5 AS contributor_pk FROM {supplier}",
    # line items as interface counters: months of shipping, octets in and out
    "counters": """SELECT l_shipdate AS event_ts, l_suppkey AS device_pk, CAST(l_linenumber AS STRING) AS intf, l_partkey AS link_pk,
        l_quantity * 1000 AS in_octets, l_quantity * (1 + l_linenumber) * 100 AS out_octets, CAST(1 + l_linenumber AS DOUBLE) AS seconds,
        CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) ELSE CAST(0 AS BIGINT) END AS errors, CASE WHEN l_discount >= 0.09 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS discards,
        CASE WHEN l_tax > 0.07 THEN CAST(-1 AS BIGINT) ELSE CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS BIGINT) END AS carrier,
        CASE WHEN l_returnflag = 'A' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS fcs, l_quantity * 2 AS in_packets, l_quantity AS out_packets, 500 + l_linenumber AS tunnel_id FROM {lineitem}""",
    # customers as validators
    "validators": """SELECT c_custkey AS node, c_name AS vote_pubkey, c_nationkey AS metro_pk, greatest(c_acctbal, CAST(0 AS DOUBLE)) AS stake, c_mktsegment AS kind FROM {customer}""",
    # routes from a supplier's nation to a customer's, as a network
    "edges": """SELECT CAST(s_nationkey AS INT) AS src, CAST(c_nationkey AS INT) AS dst, CAST(1 + CAST(sum(l_quantity) AS BIGINT) % 97 AS BIGINT) AS metric, CAST(sum(l_quantity) AS BIGINT) AS bandwidth
        FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
        WHERE s_nationkey <> c_nationkey GROUP BY s_nationkey, c_nationkey""",
    # line items as versions of links and devices, orders as those of metros, events as those of contributors
    "link_versions": """SELECT CAST(l_partkey AS STRING) AS entity_id, CAST(l_shipdate AS TIMESTAMP) AS snapshot_ts, CAST(l_shipdate AS TIMESTAMP) AS ingested_at, l_orderkey * 8 + l_linenumber AS op_id,
        CASE l_returnflag WHEN 'N' THEN 'activated' WHEN 'A' THEN 'soft-drained' ELSE 'hard-drained' END AS status, l_linestatus AS priority, l_tax > 0.07 AS is_deleted FROM {lineitem}""",
    "device_versions": """SELECT CAST(l_suppkey AS STRING) AS entity_id, CAST(l_shipdate AS TIMESTAMP) AS snapshot_ts, CAST(l_shipdate AS TIMESTAMP) AS ingested_at, (l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey AS op_id,
        CASE WHEN l_discount >= 0.09 THEN 'drained' ELSE 'activated' END AS status, l_linestatus AS priority, l_tax > 0.07 AS is_deleted FROM {lineitem}""",
    "metro_versions": """SELECT CAST(o_custkey % 997 AS STRING) AS entity_id, o_orderdate AS snapshot_ts, o_orderdate AS ingested_at, o_orderkey AS op_id,
        'activated' AS status, o_orderpriority AS priority, o_orderstatus = 'F' AS is_deleted FROM {orders}""",
    "contributor_versions": """SELECT CAST(user_id AS STRING) AS entity_id, CAST(ts AS TIMESTAMP) AS snapshot_ts, CAST(ts AS TIMESTAMP) AS ingested_at, event_id AS op_id,
        CASE WHEN value > 100 THEN 'suspended' ELSE 'activated' END AS status, event_type AS priority, event_type = 'error' AS is_deleted FROM {events}""",
    # customers as users with an address, and line items as versions of gossip nodes (suppliers) at addresses and of their vote accounts
    "user_versions": """SELECT o_custkey AS user_pk, CAST(o_custkey AS STRING) AS address, o_custkey % 40 AS device_pk, CASE o_orderstatus WHEN 'O' THEN 'activated' ELSE 'suspended' END AS status,
        o_orderdate AS at, o_orderkey AS version, o_orderstatus = 'F' AS is_deleted FROM {orders}""",
    "gossip_versions": """SELECT l_suppkey AS node, CAST(l_partkey AS STRING) AS address, CAST(l_shipdate AS TIMESTAMP) AS at, l_orderkey * 8 + l_linenumber AS version, l_tax > 0.07 AS is_deleted
        FROM {lineitem}""",
    "vote_versions": """SELECT CAST(l_suppkey AS STRING) AS vote_pubkey, l_suppkey AS node, CAST(l_quantity * 100 AS DOUBLE) AS stake, CAST(l_shipdate AS TIMESTAMP) AS at, l_orderkey * 8 + l_linenumber AS version,
        l_discount >= 0.09 AS is_deleted FROM {lineitem}""",
    # suppliers and customers that had two or more shipments, as a sparse network that grows with the tables
    "mesh": """SELECT o_custkey AS src, -l_suppkey AS dst, CAST(count(*) AS BIGINT) AS metric FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey HAVING count(*) >= 2""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


class Tables:
    """The driver's tables and the views over them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            needs = sorted(set(re.findall(r"\{(\w+)\}", VIEWS[name])))
            return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in needs})
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def _ctes(sql: str, done: dict[str, str]) -> None:
    """The views that a text names, those that they need first."""
    for name in VIEWS:
        if name not in done and re.search(rf"\b{name}\b", sql):
            _ctes(" ".join(re.findall(r"\{(\w+)\}", VIEWS[name])), done)
            done.setdefault(name, re.sub(r"\{(\w+)\}", r"\1", VIEWS[name]))


def oracle_text(sql: str) -> str:
    done: dict[str, str] = {}
    _ctes(sql, done)
    heads = [f"{k} AS ({v})" for k, v in done.items()]
    body = sql.strip()
    if body.startswith("WITH "):
        return "WITH RECURSIVE " + ",\n".join([*heads, body[5:]])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def query(oracle: str | None = None, name: str | None = None):
    """Registers f(t) -> DataFrame, t being Tables, with DuckDB SQL for the same rows."""

    def keep(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle_text(oracle)
        return f

    return keep


def ts(text: str) -> Column:
    return F.to_timestamp(F.lit(text))
