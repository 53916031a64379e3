"""What queries over the feed shuffle, and what they leave of it on disk."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import timeline
from strandline.operators import validators as v
from strandline.plans.registry import QUERIES
from strandline.sources.shared import TIDY, settled

DATA = "/root/testdata/sf0.001"
FEED = "ts timestamp, category string, kind string, entity string, severity string"


def shuffled(spark, run):
    """Records that exchanges wrote in whatever run() executes."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()

    def all_():
        bus.waitUntilEmpty()
        runs = store.executionsList()
        return [runs.apply(k).executionId() for k in range(runs.size())]

    last = max(all_(), default=-1)
    run()
    n = 0
    for number in (k for k in all_() if k > last):
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for m in (m for i in range(nodes.size()) for m in (nodes.apply(i).metrics().apply(j) for j in range(nodes.apply(i).metrics().size()))):
            value = values.get(m.accumulatorId())
            if m.name() == "shuffle records written" and value.isDefined():
                n += int(value.get().replace(",", ""))
    return n


def shuffle_files(spark):
    """Bytes by file of what shuffles have on disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = (found.apply(k) for k in range(found.size()))
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def left(spark, run):
    before = set(shuffle_files(spark))
    kept = run()
    return sum(n for name, n in shuffle_files(spark).items() if name not in before), kept


def test_a_search_shuffles_only_entities_that_it_can_find(spark):
    """Line items, orders and events are 67,000 rows; four histories of line items alone were shuffled whole."""
    assert shuffled(spark, QUERIES["event_search"](spark, DATA).collect) <= 10_000


def test_all_feeds_leave_no_shuffle_files(spark):
    """Each feed's files are gone before the next is made."""
    size, _ = left(spark, lambda: QUERIES["timeline_all_feeds"](spark, DATA).collect())
    assert size <= 20_000


def test_settled_keeps_the_rows_and_the_setting(spark):
    was = spark.conf.get(TIDY)
    df = spark.range(50_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    size, out = left(spark, lambda: settled(df))
    assert size == 0 and spark.conf.get(TIDY) == was
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("terms", [["entity:7", "Recovered"], ["metro_del", "1"]])
def test_search_is_that_of_all_events(spark, terms):
    from strandline.functions.filters import typed_terms
    from strandline.plans import timeline_queries as q
    from strandline.plans.base import Tables

    t = Tables(spark, DATA)
    found = lambda feeds: sorted(map(tuple, timeline.feed(feeds).filter(typed_terms({"entity": "entity"}, ["kind", "category", "entity"], terms)).collect()))
    assert found(q._feeds(t, terms=terms)) == found(q._feeds(t))


@pytest.mark.parametrize("second", ["b", "a"])
def test_entities_of_a_kind_in_two_feeds_count_once(spark, second):
    rows = lambda kind, names: spark.createDataFrame([(None, "c", kind, x, "info") for x in names], FEED)
    feeds = [rows("a", ["x", "x", "y"]), rows(second, ["x", "z"]), rows("d", [])]
    got = sorted((r.kind, r.n, r.n_entities) for r in timeline.summary(feeds).collect())
    assert got == ([("a", 3, 2), ("b", 2, 2)] if second == "b" else [("a", 5, 3)])


@pytest.mark.parametrize("seed", range(3))
def test_moves_of_accounts_are_those_of_their_connections(spark, seed):
    """Accounts that change nodes, have none or no stake, versions at one time, users that share an address, and nodes with many accounts."""
    import datetime as dt

    r = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * r.randrange(-10, 90))
    users = [(u, r.choice("pqr"), 1, r.choice(["activated", "activated", "off"]), at(), k, r.random() < 0.2) for k, u in enumerate(r.randrange(5) for _ in range(40))]
    gossip = [(n, r.choice(["p", "q", "r", ""]), at(), k, r.random() < 0.2) for k, n in enumerate(r.randrange(4) for _ in range(50))]
    votes = [(f"v{a}", r.randrange(5), float(r.choice([0, 5, 5, 8])), at(), k, r.random() < 0.2) for k, a in enumerate(r.randrange(6) for _ in range(80))]
    tables = [
        spark.createDataFrame(users, "user_pk long, address string, device_pk long, status string, at timestamp, version long, is_deleted boolean"),
        spark.createDataFrame(gossip, "node long, address string, at timestamp, version long, is_deleted boolean"),
        spark.createDataFrame(votes, "vote_pubkey string, node long, stake double, at timestamp, version long, is_deleted boolean"),
    ]
    hours = {"start": F.to_timestamp(F.lit("2024-01-01")), "end": F.to_timestamp(F.lit("2024-01-02 12:00:00")), "step": "1 HOUR"}
    wanted = sorted(map(tuple, v.stake_moves(v.own_stake(v.connected_spans(*tables)), **hours).select("vote_pubkey", "t", "kind", "change").collect()))
    assert sorted(map(tuple, v.connected_moves(*tables, **hours).collect())) == wanted and wanted


def test_versions_go_to_no_level_at_which_they_meet_nothing(spark):
    """Four days each, under users of years alone: once to a cell, not at their own level and among those without end too."""
    from strandline.operators.intervals import overlapping, within

    day = lambda k: F.date_add(F.lit("2024-01-01"), F.col("id").cast("int") % 10 * k).cast("timestamp")
    versions = spark.range(5000).select((F.col("id") % 50).alias("k"), "id", day(4).alias("start")).withColumn("end", F.col("start") + F.expr("INTERVAL 4 DAYS"))
    users = spark.range(50).select(F.col("id").alias("k"), F.lit("2023-12-01").cast("timestamp").alias("start"), F.lit("2024-12-01").cast("timestamp").alias("end"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: overlapping(within(versions, users, ["k"]), users, ["k"]).collect()) <= 5000 * 2 + 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert overlapping(within(versions, users, ["k"]), users, ["k"]).count() == 5000
