"""Queries on the event feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import typed_terms
from ..operators import scd2, timeline
from . import stake_queries
from .base import query, ts

LOSS = """WITH pct AS (SELECT link_pk, date_trunc('day', event_ts) AS ts, count(*) FILTER (loss OR rtt_us = 0) * 100.0::DOUBLE / count(*) AS loss_pct FROM latency GROUP BY ALL HAVING count(*) >= 2),
lagged AS (SELECT *, lag(loss_pct) OVER (PARTITION BY link_pk ORDER BY ts) AS was FROM pct),
loss_events AS (SELECT ts, CASE WHEN loss_pct >= 0.1 AND coalesce(was, 0) < 0.1 THEN 'packet_loss_started' WHEN loss_pct < 0.1 AND was >= 0.1 THEN 'packet_loss_recovered' END AS kind, CAST(link_pk AS VARCHAR) AS entity, loss_pct FROM lagged),
losses AS (SELECT ts, kind, entity, CASE WHEN kind = 'packet_loss_recovered' THEN 'success' WHEN loss_pct >= 50 THEN 'critical' ELSE 'warning' END AS severity, loss_pct FROM loss_events WHERE kind IS NOT NULL)
"""


def _losses(t):
    return timeline.packet_loss_events(t.latency, grain="day", least=2, critical=50.0)


@query(LOSS + "SELECT ts, kind, entity, severity, round(loss_pct, 6) AS loss_pct FROM losses")
def packet_loss_events(t):
    return _losses(t).withColumn("loss_pct", F.round("loss_pct", 6))


INTF = """WITH sums AS (SELECT device_pk, intf, date_trunc('month', event_ts) AS ts, sum(greatest(errors, 0)) AS errors, sum(greatest(discards, 0)) AS discards, sum(greatest(carrier, 0)) AS carrier FROM counters GROUP BY ALL),
long AS (SELECT device_pk, intf, ts, 'errors' AS m, errors AS v FROM sums UNION ALL SELECT device_pk, intf, ts, 'discards', discards FROM sums UNION ALL SELECT device_pk, intf, ts, 'carrier', carrier FROM sums),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY device_pk, intf, m ORDER BY ts) AS was FROM long),
intf_events AS (SELECT ts, device_pk, intf, CASE WHEN v > 0 AND coalesce(was, 0) = 0 THEN m || '_started' WHEN v = 0 AND was > 0 THEN m || '_stopped' END AS kind FROM lagged)
"""


@query(INTF + "SELECT * FROM intf_events WHERE kind IS NOT NULL")
def interface_events(t):
    return timeline.interface_events(t.counters, grain="month")


@query(INTF + "SELECT ts, device_pk, kind, count(*) AS n, string_agg(intf, ',' ORDER BY intf) AS interfaces FROM intf_events WHERE kind IS NOT NULL GROUP BY ALL")
def group_interface_events(t):
    return timeline.group_interface_events(timeline.interface_events(t.counters, grain="month"))


CHANGES = """WITH lg AS (SELECT *, row_number() OVER w AS n, lag(is_deleted) OVER w AS was_deleted, lag(status) OVER w AS was_status, lag(priority) OVER w AS was_priority
  FROM history WINDOW w AS (PARTITION BY entity_id ORDER BY snapshot_ts, ingested_at, op_id)),
kinds AS (SELECT *, CASE WHEN is_deleted AND NOT coalesce(was_deleted, true) THEN 'deleted' WHEN NOT is_deleted AND n > 1 AND was_deleted THEN 'created'
  WHEN n = 1 AND NOT is_deleted THEN 'created' WHEN NOT is_deleted AND (status <> was_status OR priority <> was_priority) THEN 'updated' END AS change FROM lg),
changes AS (SELECT snapshot_ts AS ts, 'user' AS category, 'user_' || change AS kind, entity_id AS entity, CASE WHEN change = 'deleted' OR (change = 'updated' AND status <> was_status AND status <> 'activated') THEN 'warning' ELSE 'info' END AS severity, op_id
  FROM kinds WHERE change IS NOT NULL AND snapshot_ts >= TIMESTAMP '1996-01-01' AND snapshot_ts < TIMESTAMP '1999-01-01' AND NOT (change = 'created' AND n = 1 AND snapshot_ts = (SELECT min(snapshot_ts) FROM history)))
"""


def _on(of, column):
    """of, a condition by the name of a column or None, on that one."""
    return None if of is None else of(column)


def _only(rows, of, column):
    return rows if of is None else rows.filter(of(column))


def _changes(t, of=None):
    return timeline.change_events(scd2.change_log(t.history, ["status", "priority"], ts("1996-01-01"), ts("1999-01-01"), _on(of, "entity_id")), "user")


@query(CHANGES + "SELECT * FROM changes")
def entity_change_events(t):
    return _changes(t)


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY (value > 100) DESC, event_id) AS n FROM events) WHERE n = 1")
def dedup_validator_events(t):
    rows = t.events.withColumn("day", F.date_trunc("day", "ts"))
    return timeline.dedup_events(rows, ["user_id", "event_type", "day"], F.col("value") > 100, "event_id").select("event_id", "user_id", "event_type", "ts")


FEED = LOSS + ", " + CHANGES[5:] + """, feed AS (SELECT ts, category, kind, entity, severity FROM changes UNION ALL SELECT ts, 'packet_loss', kind, entity, severity FROM losses)
"""


def _loss_feed(t):
    return _losses(t).withColumn("category", F.lit("packet_loss"))


def _feed(t):
    return timeline.feed([_changes(t), _loss_feed(t)]).select("ts", "category", "kind", "entity", "severity")


@query(FEED + "SELECT * FROM feed WHERE severity IN ('warning', 'critical')")
def timeline_feed(t):
    return timeline.feed([_feed(t)], severities=["warning", "critical"])



def _customer_moves(t, of=None):
    """Customers whose orders begin or cease to be open, as nodes that join and leave."""
    state = _only(t.history, of, "entity_id").withColumn("state", F.when(F.col("status") == "activated", "joined").otherwise("left"))
    moves = scd2.status_transitions(state, "state")
    stakes = t.validators.select(F.col("node").cast("string").alias("entity_id"), "node", (F.col("stake") > 0).alias("is_validator"))
    return moves.join(stakes, "entity_id").select("node", "at", F.col("new").alias("event"), "is_validator")


def _changes_sql(view: str, category: str) -> str:
    """CTEs lg_, kinds_ and changes_ of a category, as CHANGES has them for users."""
    return f"""lg_{category} AS (SELECT *, row_number() OVER w AS n, lag(is_deleted) OVER w AS was_deleted, lag(status) OVER w AS was_status, lag(priority) OVER w AS was_priority
  FROM {view} WINDOW w AS (PARTITION BY entity_id ORDER BY snapshot_ts, ingested_at, op_id)),
kinds_{category} AS (SELECT *, CASE WHEN is_deleted AND NOT coalesce(was_deleted, true) THEN 'deleted' WHEN NOT is_deleted AND n > 1 AND was_deleted THEN 'created'
  WHEN n = 1 AND NOT is_deleted THEN 'created' WHEN NOT is_deleted AND (status <> was_status OR priority <> was_priority) THEN 'updated' END AS change FROM lg_{category}),
changes_{category} AS (SELECT snapshot_ts AS ts, '{category}' AS category, '{category}_' || change AS kind, entity_id AS entity, CASE WHEN change = 'deleted' OR (change = 'updated' AND status <> was_status AND status <> 'activated') THEN 'warning' ELSE 'info' END AS severity, op_id
  FROM kinds_{category} WHERE change IS NOT NULL AND NOT (change = 'created' AND n = 1 AND snapshot_ts = (SELECT min(snapshot_ts) FROM {view})))
"""


SINCE, UNTIL = "1990-01-01", "2030-01-01"
KINDS = {"link": "link_versions", "device": "device_versions", "metro": "metro_versions", "contributor": "contributor_versions"}


def _kind_changes(t, category, of=None):
    return timeline.change_events(scd2.change_log(getattr(t, KINDS[category]), ["status", "priority"], ts(SINCE), ts(UNTIL), _on(of, "entity_id")), category)


def _register_changes(category):
    @query("WITH " + _changes_sql(KINDS[category], category) + f"SELECT * FROM changes_{category}", f"{category}_change_events")
    def change_events(t):
        return _kind_changes(t, category)


for _category in KINDS:
    _register_changes(_category)

MOVES = """moved AS (SELECT o_orderdate AS ts, CASE WHEN stake > 0 THEN 'validator' ELSE 'gossip_node' END AS category, CASE WHEN o_orderstatus = 'O' THEN 'joined' ELSE 'left' END AS event, CAST(o_custkey AS VARCHAR) AS entity
  FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders) JOIN validators ON node = o_custkey WHERE was IS NOT NULL AND (was = 'O') <> (o_orderstatus = 'O')),
node_events AS (SELECT ts, category, category || '_' || event AS kind, entity, CASE WHEN event = 'left' THEN 'warning' ELSE 'info' END AS severity FROM moved)
"""


def _node_events(t, of=None):
    moves = _customer_moves(t, of)
    return timeline.node_events(moves.select(F.col("at").alias("ts"), F.col("node").cast("string").alias("entity"), "event", "is_validator"))


@query("WITH " + MOVES + "SELECT * FROM node_events")
def node_events(t):
    return _node_events(t)


ACCOUNTS = """account_seen AS (SELECT entity_id, min(snapshot_ts) AS f, max(snapshot_ts) AS l FROM history WHERE NOT is_deleted GROUP BY 1),
account_now AS (SELECT entity_id FROM history GROUP BY 1 HAVING NOT arg_max(is_deleted, (snapshot_ts, ingested_at, op_id))),
account_events AS (SELECT f AS ts, 'vote_account' AS category, 'vote_account_joined' AS kind, entity_id AS entity, 'info' AS severity FROM account_seen
  UNION ALL SELECT l, 'vote_account', 'vote_account_left', entity_id, 'warning' FROM account_seen WHERE entity_id NOT IN (SELECT entity_id FROM account_now))
"""


def _account_events(t, of=None):
    history = _only(t.history, of, "entity_id")
    now = scd2.latest(history, "entity_id").filter(~F.col("is_deleted"))
    return timeline.account_events(scd2.first_last_seen(history, now, ts(SINCE), ts(UNTIL), ["status"]))


@query("WITH " + ACCOUNTS + "SELECT * FROM account_events")
def account_events(t):
    return _account_events(t)


STAKES = """stake_lag AS (SELECT user_id AS node, ts, value AS stake, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
stake_events AS (SELECT ts, 'stake' AS category, CASE WHEN stake < previous THEN 'validator_stake_decreased' ELSE 'validator_stake_increased' END AS kind, CAST(node AS VARCHAR) AS entity, CASE WHEN stake < previous THEN 'warning' ELSE 'info' END AS severity
  FROM stake_lag WHERE previous IS NOT NULL AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND stake <> previous AND (abs(stake - previous) >= 200 OR abs(stake - previous) * 100 / nullif(previous, 0) >= 500))
"""


@query("WITH " + STAKES + "SELECT * FROM stake_events")
def stake_events(t):
    return _stake_events(t)


def _stake_events(t, of=None):
    return timeline.stake_events(stake_queries._stake_changes(t, of))


ATTRIBUTED = stake_queries.ATTRIBUTION + ", attributed AS (SELECT t AS ts, 'attribution' AS category, 'validator_' || kind AS kind, vote_pubkey AS entity, CASE WHEN change < 0 THEN 'warning' ELSE 'info' END AS severity FROM reasons)\n"


def _attribution_events(t, **asked):
    return timeline.attribution_events(stake_queries._attribution(t, **asked).withColumnRenamed("vote_pubkey", "node"))


@query(ATTRIBUTED + "SELECT * FROM attributed")
def attribution_events(t):
    return _attribution_events(t)


TROUBLE = INTF[5:].replace("lagged", "intf_lagged") + ", trouble AS (SELECT DISTINCT ts, 'interface' AS category, 'interface_' || kind AS kind, CAST(device_pk AS VARCHAR) AS entity, CASE WHEN kind LIKE '%started' THEN 'warning' ELSE 'success' END AS severity FROM intf_events WHERE kind IS NOT NULL)\n"

ALL_FEEDS = ATTRIBUTED + ", " + ", ".join([FEED[5:], MOVES, ACCOUNTS, STAKES, TROUBLE, *(_changes_sql(v, k) for k, v in KINDS.items())]) + """, all_feeds AS (SELECT * FROM feed UNION ALL SELECT * FROM attributed UNION ALL SELECT * FROM node_events UNION ALL SELECT * FROM account_events
  UNION ALL SELECT * FROM stake_events UNION ALL SELECT * FROM trouble""" + "".join(f" UNION ALL SELECT ts, category, kind, entity, severity FROM changes_{k}" for k in KINDS) + ")\n"


def _trouble(t, of=None):
    return timeline.trouble_events(timeline.group_interface_events(timeline.interface_events(_only(t.counters, of, "device_pk"), grain="month")))


def _asked(start, end=None):
    """What moves the connected total at an hour depends on the connections of that hour and the one before, so no others are made."""
    return {} if start is None else {"since": start - F.expr("INTERVAL 2 HOURS"), "until": end}


def _plain(f):
    return f.select("ts", "category", "kind", "entity", "severity")


def _joined_events(t):
    """Of what moves the connected total, who joins."""
    return _attribution_events(t).filter("kind = 'validator_joined'")


def _feeds(t, start=None, end=None, attributed=None, terms=None):
    """All feeds. start and end: events before or from then on may be missing or wrong. attributed: what moves the connected total, if not all is wanted.
    terms: of entities that a search for them can't find, events may be missing."""
    found = (lambda *_: None) if terms is None else timeline.searched(terms)
    of = lambda category, *ends, prefix=None: found(category, [f"{prefix or category}_{x}" for x in ends])
    changed = ("created", "updated", "deleted")
    nodes = found("validator gossip_node", [f"{c}_{x}" for c in ("validator", "gossip_node") for x in ("joined", "left")])
    feeds = [
        _changes(t, of("user", *changed)), _loss_feed(t),
        _attribution_events(t, of=of("attribution", "joined", "left", "stake_changed", prefix="validator"), **_asked(start, end)) if attributed is None else attributed,
        _node_events(t, nodes), _account_events(t, of("vote_account", "joined", "left")), _stake_events(t, of("stake", "stake_decreased", "stake_increased", prefix="validator")),
        _trouble(t, of("interface", *(f"{m}_{x}" for m in ("errors", "discards", "carrier") for x in ("started", "stopped")))), *(_kind_changes(t, k, of(k, *changed)) for k in KINDS),
    ]
    return [_plain(f) for f in feeds]


def _newest_feeds(t):
    """All feeds with their newest times, as feed_page() takes them. No event is later than the last row it is made from, but what moves
    the connected total counts at the next full hour."""
    last = lambda rows, c: rows.agg(F.max(F.col(c).cast("timestamp")).alias("at"))
    orders, items, events = last(t.orders, "o_orderdate"), last(t.lineitem, "l_shipdate"), last(t.events, "ts")
    total = orders.unionByName(items).agg((F.max("at") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    feeds = [
        (orders, lambda _: _changes(t)), (events, lambda _: _loss_feed(t)), (total, lambda since: _attribution_events(t, **_asked(since))), (orders, lambda _: _node_events(t)), (orders, lambda _: _account_events(t)),
        (events, lambda _: stake_events(t)), (items, lambda _: _trouble(t)), *((at, lambda _, k=k: _kind_changes(t, k)) for at, k in zip((items, items, orders, events), KINDS, strict=True)),
    ]
    return [(at, lambda since, make=make: _plain(make(since))) for at, make in feeds]


def _all_feeds(t, start=None, end=None):
    return timeline.feed(_feeds(t, start, end), start=start, end=end)


IDS = ALL_FEEDS + """, named AS (SELECT *, left(sha256(entity || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z:' || kind), 16) AS event_id FROM all_feeds)
"""


@query(IDS + "SELECT * FROM named ORDER BY ts DESC, event_id, category, severity LIMIT 100 OFFSET 100")
def timeline_page(t):
    return timeline.feed_page(_newest_feeds(t), 100, 100)


@query(IDS + "SELECT * FROM named WHERE contains(entity, '77') OR contains(lower(kind), 'recovered') OR contains(lower(category), 'recovered') OR contains(lower(entity), 'recovered')")
def event_search(t):
    terms = ["entity:77", "Recovered"]
    found = timeline.feed(_feeds(t, terms=terms)).filter(typed_terms({"entity": "entity"}, ["kind", "category", "entity"], terms))
    return timeline.with_id(found)


@query(ALL_FEEDS + "SELECT b AS bucket, count(f.ts) AS n FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-12-31', INTERVAL 1 DAY) g(b) LEFT JOIN all_feeds f ON f.ts >= b AND f.ts < b + INTERVAL 1 DAY GROUP BY b")
def event_histogram(t):
    start, end = ts("1995-01-01"), ts("1996-01-01")
    return timeline.histogram(_all_feeds(t, start, end), start=start, end=end, bucket="1 DAY", one_row=t.region.limit(1))


@query(ALL_FEEDS + "SELECT * FROM all_feeds WHERE kind LIKE '%\\_created%' ESCAPE '\\' OR kind LIKE '%\\_joined%' ESCAPE '\\' OR kind LIKE '%\\_stopped%' ESCAPE '\\' OR kind LIKE '%\\_recovered%' ESCAPE '\\' OR kind LIKE '%\\_stake\\_decreased%' ESCAPE '\\'")
def timeline_by_action(t):
    events = timeline.feed(_feeds(t, attributed=_joined_events(t)))  # those that leave or change stake are neither
    return timeline.by_action(events, ["added", "resolved"])


@query(ALL_FEEDS + "SELECT category, kind, severity, count(*) AS n, count(DISTINCT entity) AS n_entities, max(ts) AS newest FROM all_feeds GROUP BY ALL")
def timeline_all_feeds(t):
    return timeline.summary(_feeds(t))


NETWORK = "WITH " + MOVES + ", " + STAKES + ", " + ACCOUNTS + ", " + stake_queries.ON[5:] + """, related AS (SELECT * FROM node_events UNION ALL SELECT ts, 'validator', kind, entity, severity FROM stake_events UNION ALL SELECT * FROM account_events)
SELECT r.* FROM related r LEFT JOIN validators v ON CAST(v.node AS VARCHAR) = r.entity LEFT JOIN on_net o ON o.node = v.node
"""


def _related(t):
    nodes = t.validators.join(stake_queries._on(t).select("node", F.lit(True).alias("is_on")), "node", "left")
    events = timeline.feed([_node_events(t), stake_events(t).withColumn("category", F.lit("validator")), _account_events(t)])
    return events, nodes.select(F.col("node").cast("string").alias("entity"), "stake", "is_on")


@query(NETWORK + "WHERE r.category NOT IN ('validator', 'gossip_node') OR (coalesce(v.stake, 0) >= 1000 AND (o.node IS NOT NULL OR r.kind LIKE '%joined' OR r.kind LIKE '%left'))")
def timeline_on_net(t):
    return timeline.by_network(*_related(t), on=True, least_stake=1000.0)


@query(NETWORK + "WHERE r.category NOT IN ('validator', 'gossip_node') OR (o.node IS NULL AND r.kind NOT LIKE '%joined' AND r.kind NOT LIKE '%left')")
def timeline_off_net(t):
    return timeline.by_network(*_related(t), on=False)
