"""Small literal cases of the core operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.functions import filters, keys, numbers
from strandline.operators import facts, graph, joins, outages, scd2, timeline, traffic, validators
from strandline.sources import catalog, tables

T0 = datetime(2024, 1, 1)
HISTORY = "entity_id string, snapshot_ts timestamp, ingested_at timestamp, op_id long, is_deleted boolean, status string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def history(spark, *rows):
    return spark.createDataFrame([(e, at(m), at(m), op, d, s) for e, m, op, d, s in rows], HISTORY)


def lit(t):
    return F.lit(t).cast("timestamp")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_length_delimited_keys_differ(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert df.select(keys.surrogate_key("x", "y")).distinct().count() == 2


def test_null_and_text_hash_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a")], "x string, y string")
    assert df.select(keys.attrs_hash("x", "y")).distinct().count() == 3


class TestHistory:
    def test_insert_update_same_delete(self, spark):
        h = history(spark, ("a", 0, 1, False, "up"), ("b", 0, 1, False, "up"), ("c", 0, 1, False, "up"))
        s = history(spark, ("a", 5, 2, False, "up"), ("b", 5, 2, False, "down"), ("d", 5, 2, False, "up"))
        new = scd2.delta(h, s, ["status"], at=lit(at(5)), op_id=F.lit(2).cast("long"), missing_means_deleted=True)
        assert rows(new.select("entity_id", "change", "status", "is_deleted"), "entity_id") == [("b", "updated", "down", False), ("c", "deleted", "up", True), ("d", "created", "up", False)]
        kept = scd2.delta(h, s, ["status"], at=lit(at(5)), op_id=F.lit(2).cast("long"))
        assert rows(kept.select("entity_id"), "entity_id") == [("b",), ("d",)]

    def test_same_op_twice_gives_nothing(self, spark):
        h = history(spark, ("a", 0, 2, False, "up"))
        s = history(spark, ("a", 5, 2, False, "down"))
        assert scd2.delta(h, s, ["status"], at=lit(at(5)), op_id=F.lit(2).cast("long")).count() == 0

    def test_empty_history(self, spark):
        s = history(spark, ("a", 5, 2, False, "down"))
        assert scd2.delta(history(spark), s, ["status"], at=lit(at(5)), op_id=F.lit(2).cast("long")).count() == 1

    def test_duplicate_in_snapshot_resolves_to_highest_version(self, spark):
        s = history(spark, ("a", 5, 1, False, "x"), ("a", 5, 2, False, "y"))
        assert rows(scd2.dedup_snapshot(s).select("status")) == [("y",)]

    def test_tombstone_hides_then_recreated(self, spark):
        h = history(spark, ("a", 0, 1, False, "up"), ("a", 5, 2, True, "up"), ("a", 9, 3, False, "new"))
        read = lambda m: rows(scd2.as_of_state(h, lit(at(m))).select("status"))
        assert [read(m) for m in (-1, 0, 4, 5, 8, 9)] == [[], [("up",)], [("up",)], [], [], [("new",)]]
        assert rows(scd2.current_state(h).select("status")) == [("new",)]

    def test_replay_gives_every_snapshot_back(self, spark):
        snapshots = [{"a": "x", "b": "x"}, {"a": "y"}, {"a": "y", "b": "z"}, {}, {"c": "x"}]
        h = history(spark)
        for i, snap in enumerate(snapshots):
            s = history(spark, *[(k, i, i, False, v) for k, v in snap.items()])
            new = scd2.delta(h, s, ["status"], at=lit(at(i)), op_id=F.lit(i).cast("long"), missing_means_deleted=True)
            got = [(r.entity_id, i, i, r.is_deleted, r.status) for r in new.collect()]
            h = history(spark, *[(r.entity_id, (r.snapshot_ts - T0).seconds // 60, r.op_id, r.is_deleted, r.status) for r in h.collect()], *got)
        for i, snap in enumerate(snapshots):
            assert dict(rows(scd2.as_of_state(h, lit(at(i))).select("entity_id", "status"))) == snap


class TestFacts:
    def test_later_version_wins(self, spark):
        df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, v int, s string")
        assert rows(facts.dedup_latest(df, ["k"], ["v"]).select("k", "s"), "k") == [(1, "new"), (2, "x")]

    def test_jitter_skips_losses(self, spark):
        df = spark.createDataFrame([(1, 1, 10), (1, 2, 0), (1, 3, 14), (2, 1, 5)], "c int, i int, rtt_us int")
        got = facts.ipdv(df, ["c"], ["i"])
        assert rows(got.select("c", "i", "ipdv_us", "loss"), "c", "i") == [(1, 1, None, False), (1, 2, None, True), (1, 3, 4, False), (2, 1, None, False)]

    def test_first_row_is_a_baseline(self, spark):
        df = spark.createDataFrame([(1, at(0), 10, None), (1, at(1), 15, 3), (1, at(2), 12, None), (1, at(3), 20, 7)], "k int, event_ts timestamp, n int, e int")
        got = facts.counter_deltas(df, ["k"], ["event_ts"], ["n", "e"], sparse=("e",))
        assert rows(got.select("n_delta", "e_delta", "delta_seconds"), "event_ts") == [(5, None, 60.0), (-3, None, 60.0), (8, 4, 60.0)]

    def test_a_baseline_gives_the_first_row_too(self, spark):
        df = spark.createDataFrame([(1, at(5), 10)], "k int, event_ts timestamp, n int")
        base = spark.createDataFrame([(1, 4)], "k int, n int")
        assert rows(facts.counter_deltas(df, ["k"], ["event_ts"], ["n"], baselines=base).select("n_delta")) == [(6,)]

    def test_credits(self, spark):
        df = spark.createDataFrame([("v", 1, 1, 10), ("v", 2, 1, 15), ("v", 3, 1, 12), ("v", 4, 2, 1)], "k string, o int, e int, c int")
        assert [r[0] for r in rows(facts.credits_delta(df, "k", "o", "e", "c").select("credits_delta", "o"), "o")] == [None, 5, 0, None]

    def test_tunnel(self, spark):
        df = spark.createDataFrame([("Tunnel123",), ("Ethernet1",), ("tunnel",), (None,)], "i string")
        assert [r[0] for r in df.select(facts.tunnel_id(F.col("i"))).collect()] == [123, None, None, None]


class TestOutages:
    def merge(self, spark, *spans):
        df = spark.createDataFrame([(1, at(a), None if b is None else at(b), float(p)) for a, b, p in spans], "link_pk int, start_ts timestamp, end_ts timestamp, peak double")
        return [(r.start_ts, r.end_ts, r.peak) for r in outages.coalesce_outages(df).orderBy("start_ts").collect()]

    def test_near_ones_merge(self, spark):
        assert self.merge(spark, (0, 10, 5), (20, 30, 9)) == [(at(0), at(30), 9.0)]

    def test_far_ones_stay(self, spark):
        assert len(self.merge(spark, (0, 10, 5), (40, 50, 9))) == 2

    def test_ongoing_absorbs_later_ones(self, spark):
        assert self.merge(spark, (0, None, 5), (500, 600, 9)) == [(at(0), None, 9.0)]

    def test_ongoing_tail(self, spark):
        assert self.merge(spark, (0, 10, 5), (15, None, 1)) == [(at(0), None, 5.0)]

    def test_single_bucket_is_no_outage(self, spark):
        b = spark.createDataFrame([(1, at(5 * i), p, 9) for i, p in enumerate([0.0, 50.0, 0.0, 20.0, 30.0])], "link_pk int, bucket timestamp, loss_pct double, n int")
        got = outages.loss_outages(b).collect()
        assert [(r.start_ts, r.end_ts, r.peak_loss_pct, r.severity) for r in got] == [(at(15), at(25), 30.0, "outage")]
        assert outages.loss_ongoing(b, threshold=10.0).collect()[0].start_ts == at(15)

    def test_soft_to_hard_is_one_period(self, spark):
        h = history(spark, ("a", 0, 1, False, "activated"), ("a", 5, 2, False, "soft-drained"), ("a", 7, 3, False, "hard-drained"), ("a", 9, 4, False, "activated"), ("b", 0, 1, False, "soft-drained"), ("b", 5, 2, False, "activated"))
        assert rows(outages.status_outages(h)) == [("a", at(5), at(9), True, 240.0)]

    @pytest.mark.parametrize(("period", "kept"), [((20, 30), True), ((0, 30), False), ((5, 8), False), ((5, None), False), ((10, None), True)])
    def test_overlap(self, spark, period, kept):
        g = spark.createDataFrame([(1, at(0), at(10))], "k int, start_ts timestamp, end_ts timestamp")
        p = spark.createDataFrame([(1, at(period[0]), None if period[1] is None else at(period[1]))], "k int, start_ts timestamp, end_ts timestamp")
        assert (joins.overlap_anti(g, p, ["k"]).count() == 1) is kept


class TestJoins:
    def test_asof_takes_equal_times_and_keeps_misses(self, spark):
        left = spark.createDataFrame([(1, at(0)), (1, at(5)), (2, at(5))], "k int, t timestamp")
        right = spark.createDataFrame([(1, at(5), "b"), (1, at(3), "a")], "k int, t timestamp, v string")
        assert rows(joins.asof_join(left, right, ["k"], "t", "t", ["v"]).select("k", "t", "v"), "k", "t") == [(1, at(0), None), (1, at(5), "b"), (2, at(5), None)]

    def test_asof_tolerance(self, spark):
        left = spark.createDataFrame([(1, at(60))], "k int, t timestamp")
        right = spark.createDataFrame([(1, at(0), "a")], "k int, t timestamp, v string")
        assert rows(joins.asof_join(left, right, ["k"], "t", "t", ["v"], tolerance_seconds=60).select("v")) == [(None,)]

    def test_addresses(self, spark):
        df = spark.createDataFrame([("10.0.0.2/31",), ("10.0.0.2/30",)], "n string")
        assert [r[0] for r in df.select(joins.cidr_pair(F.col("n"))).collect()] == [[167772162, 167772163], None]


def test_graph_paths(spark):
    e = spark.createDataFrame([(0, 1, 5, 10), (1, 2, 5, 10), (0, 2, 20, 3), (2, 3, 1, 9)], "src int, dst int, metric long, bandwidth long")
    s = spark.createDataFrame([(0,)], "src int")
    best = {r.dst: (r.cost, r.path) for r in graph.best_paths(e, s).collect()}
    assert best == {0: (0, [0]), 1: (5, [0, 1]), 2: (10, [0, 1, 2]), 3: (11, [0, 1, 2, 3])}
    assert {r.dst: r.hops for r in graph.best_paths(e, s, cost="hops").collect()}[3] == 2
    assert {r.dst: -r.cost for r in graph.best_paths(e, s, cost="bottleneck").collect()}[3] == 9
    assert [(r.n, r.cost) for r in graph.ranked_paths(e, s.withColumn("dst", F.lit(3)), k=5).orderBy("n").collect()] == [(1, 11), (2, 21)]


def test_drained_links_give_no_adjacency(spark):
    links = spark.createDataFrame([(1, 2, "x.0", "x.1", "soft-drained", 1.0), (2, 3, "y.0", "y.1", "activated", 1.0)], "a_pk int, z_pk int, a_addr string, z_addr string, status string, bandwidth double")
    heard = spark.createDataFrame([(1, "x.1", 7), (2, "y.1", 8)], "src int, neighbor_addr string, metric long")
    assert rows(graph.adjacency(heard, links).select("src", "dst", "metric")) == [(2, 3, 8)]


def test_moves_and_walkback(spark):
    on = spark.createDataFrame([("1", 10.0, at(-5), at(1)), ("1", 12.0, at(1), None), ("2", 5.0, at(-5), at(1)), ("3", 4.0, at(1), None), ("4", 7.0, at(0), at(0))], "vote_pubkey string, stake double, start timestamp, end timestamp")
    moves = validators.stake_moves(on, start=F.lit(at(0)), end=F.lit(at(2)), step="1 MINUTE")
    assert rows(moves.select("vote_pubkey", "kind", "change"), "vote_pubkey") == [("1", "stake_changed", 2.0), ("2", "left", -5.0), ("3", "joined", 4.0)]
    now = spark.createDataFrame([(50.0, 100.0)], "share_pct double, total_stake double")
    assert rows(validators.walkback(moves, now).select("change", "share_pct")) == [(1.0, 50.0)]


@pytest.mark.parametrize(("text", "kind", "yes", "no"), [(">10k", "number", 10001.0, 10000.0), ("<= 5", "bandwidth", 5e9, 5.1e9), (">=2mbps", "bandwidth", 2e6, 1.9e6), ("==3m", "stake", 3e6, 3.0)])
def test_numeric_filters(spark, text, kind, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "x double")
    assert [r[0] for r in df.filter(filters.numeric(F.col("x"), text, kind)).collect()] == [yes]


def test_bad_filters():
    assert filters.numeric(None, "ten") is None and filters.numeric(None, ">5gbps") is None and filters.boolean(None, "maybe") is None


def test_time_ranges():
    assert filters.time_range("24h", now=at(0)) == (at(-1440), at(0), 300)
    assert filters.time_range(start=at(0), end=at(30), now=at(0))[2] == 10


def test_typed_terms(spark):
    df = spark.createDataFrame([("fra", "link"), ("nyc", "fra-1")], "metro string, name string")
    assert df.filter(filters.typed_terms({"metro": "metro"}, ["metro", "name"], ["metro:FRA"])).count() == 1
    assert df.filter(filters.typed_terms({"metro": "metro"}, ["metro", "name"], ["fra"])).count() == 2


def test_resets_are_left_out_of_rates_and_clamped_in_sums(spark):
    c = spark.createDataFrame([(1, "e", 100.0, 0.0, 10.0, -5), (1, "e", -50.0, 0.0, 10.0, 3), (1, "e", 300.0, 0.0, 10.0, None)], "device_pk int, intf string, in_octets double, out_octets double, seconds double, errors int")
    got = traffic.interface_rates(c, ["device_pk"]).first()
    assert (got.in_bps, got.peak_in_bps) == (160.0, 240.0)
    assert c.agg(numbers.clamped_sum(F.col("errors"))).first()[0] == 3


def test_perspective_swaps(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "in_bps double, out_bps double")
    assert tuple(traffic.perspective(df, "user").first()) == (2.0, 1.0)


def test_events_without_contribution_give_way(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b")], "k int, c int, id string")
    assert rows(timeline.dedup_events(df, ["k"], F.col("c").isNotNull(), "id").select("id")) == [("b",)]


def test_sql_text(spark):
    assert catalog.run_sql(spark, " SELECT :x AS x ; ", {"x": 3}).first()[0] == 3
    with pytest.raises(ValueError, match="empty"):
        catalog.run_sql(spark, " ; ")


def test_an_empty_source_is_refused(spark):
    with pytest.raises(ValueError, match="devices"):
        tables.require_rows(spark.createDataFrame([], "x int"), "devices")


def test_fact_append_checks_columns(spark, tmp_path):
    df = spark.createDataFrame([(at(0), 1)], "event_ts timestamp, x int")
    facts.append(df, str(tmp_path / "f"), df)
    facts.append(df, str(tmp_path / "f"), df)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    with pytest.raises(ValueError, match="differ"):
        facts.append(df.drop("x"), str(tmp_path / "f"), df)


def test_snapshots_are_refused_as_a_whole(spark):
    from strandline.sources import snapshots

    one = lambda: spark.createDataFrame([(1, "x")], "pk int, code string")
    full = {k: one() for k in snapshots.REQUIRED}
    groups = spark.createDataFrame([(k, k) for k in (0, 1, 2, 3, 7)], "pk int, status int")
    got = snapshots.snapshots({**full, "users": one().limit(0), "multicast_groups": groups})
    assert got["users"].count() == 0 and got["metros"].first().longitude is None
    assert [r.status for r in got["multicast_groups"].orderBy("entity_id").collect()] == ["pending", "activated", "suspended", "deleted", "unknown"]
    for kind in snapshots.REQUIRED:
        with pytest.raises(ValueError, match=f"{kind} is empty"):
            snapshots.snapshots({**full, kind: one().limit(0)})
    with pytest.raises(ValueError, match="no such kind"):
        snapshots.snapshots({**full, "routers": one()})
