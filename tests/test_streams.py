"""Streams over several deliveries: state is carried, runs out, and late or repeated rows change nothing else."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandline.streaming import streams

SCHEMA = "k long, n long, v double, ts timestamp"


def at(day):
    return datetime(2024, 1, 1) + timedelta(days=day)


def deliver(spark, tmp_path, parts, run):
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        out = run(streams.read_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA), str(tmp_path / "run"))
    return out


def test_previous_values_cross_deliveries_and_run_out(spark, tmp_path):
    parts = [[(1, 1, 5.0, at(0)), (1, 2, -1.0, at(1)), (2, 1, 7.0, at(0))], [(1, 3, 8.0, at(50)), (3, 1, 1.0, at(50))], [(3, 2, 2.0, at(100))], [(1, 4, 9.0, at(101)), (2, 2, 3.0, at(101))]]
    run = lambda rows, root: streams.with_previous(rows, "k", ["n"], "v", F.col("v") > 0, ts="ts", ttl="90 DAY", root=root)
    got = {(r.k, r.n): r.previous for r in deliver(spark, tmp_path, parts, run).collect()}
    # Key 2 was last heard of 100 days before the third delivery.
    assert got == {(1, 1): None, (1, 2): 5.0, (2, 1): None, (1, 3): 5.0, (3, 1): None, (3, 2): 1.0, (1, 4): 8.0, (2, 2): None}


def test_dedup_and_sessions_cross_deliveries_and_late_rows_are_dropped(spark, tmp_path):
    parts = [[(1, 1, 0.0, at(0)), (1, 2, 0.0, at(0.1))], [(1, 1, 0.0, at(0.2)), (1, 3, 0.0, at(20))], [(1, 4, 0.0, at(1)), (1, 5, 0.0, at(40))]]
    once = deliver(spark, tmp_path / "a", parts, lambda rows, root: streams.run_available(streams.dedup(rows, ["k", "n"], "ts", "1 day").select("n"), root=root))
    assert sorted(r.n for r in once.collect()) == [1, 2, 3, 5]  # 1 comes twice, 4 is late
    sessions = deliver(spark, tmp_path / "b", parts, lambda rows, root: streams.run_available(streams.sessions(rows, "ts", "1 hour", "2 days", "k"), root=root))
    assert sorted((r.start_ts, r.n) for r in sessions.collect()) == [(at(0), 3), (at(20), 1)]
