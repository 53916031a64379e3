"""Rules of link, device and network status at their limits."""

import datetime

import pytest
from pyspark.sql import functions as F

from strandline.operators import health

DAY = datetime.datetime(2024, 1, 1)


def links(spark, rows):
    return spark.createDataFrame(rows, "link_pk long, code string, status string, committed_rtt_us double, bandwidth_bps double, link_type string, side_a int, side_z int")


@pytest.mark.parametrize(
    "counted,used,want",
    [
        ((0, 0, 0), 10.0, "healthy"), ((1, 0, 0), 10.0, "degraded"), ((40, 40, 40), 10.0, "degraded"), ((0, 100, 0), 10.0, "unhealthy"), ((0, 0, 99), 10.0, "degraded"),
        ((0, 0, 100), 10.0, "unhealthy"), ((0, 0, 0), 80.0, "healthy"), ((0, 0, 0), 80.1, "degraded"), ((-5, None, 0), 10.0, "healthy"),
    ],
)
def test_interfaces_and_use_change_a_healthy_link(spark, counted, used, want):
    link = links(spark, [(1, "a", "activated", 100.0, 1000.0, "WAN", 1, 2)])
    samples = spark.createDataFrame([(1, DAY, 90.0, False)], "link_pk long, event_ts timestamp, rtt_us double, loss boolean")
    rows = [(1, DAY, used * 10 / 8, 0.0, 1.0, *counted)]
    counters = spark.createDataFrame(rows, "link_pk long, event_ts timestamp, in_octets double, out_octets double, seconds double, errors long, discards long, carrier long")
    usage = health.link_usage(counters, link, bucket="1 DAY")
    (got,) = health.link_history(samples, link, start=F.lit(DAY), end=F.lit(DAY + datetime.timedelta(days=1)), bucket="1 DAY", usage=usage).collect()
    assert got.status == want and ("high_utilization" in got.reasons) == (used > 80)


def test_many_errors_make_a_degraded_link_unhealthy_but_leave_a_disabled_one(spark):
    link = links(spark, [(1, "a", "activated", 100.0, 1e9, "WAN", 1, 2), (2, "b", "soft-drained", 100.0, 1e9, "WAN", 1, 2), (3, "c", "activated", 100.0, 1e9, "LOCAL", 1, 2), (4, "d", "activated", 100.0, 1e9, "WAN", 3, 3)])
    samples = spark.createDataFrame([(k, DAY, 130.0, False) for k in (1, 2, 3, 4)], "link_pk long, event_ts timestamp, rtt_us double, loss boolean")
    counters = spark.createDataFrame([(k, DAY, 1.0, 1.0, 1.0, 100, 0, 0) for k in (1, 2)], "link_pk long, event_ts timestamp, in_octets double, out_octets double, seconds double, errors long, discards long, carrier long")
    span = {"start": F.lit(DAY), "end": F.lit(DAY + datetime.timedelta(days=1)), "bucket": "1 DAY"}
    plain = {r.link_pk: r.status for r in health.link_history(samples, link, **span).collect()}
    assert plain == {1: "degraded", 2: "disabled", 3: "healthy", 4: "healthy"}
    got = {r.link_pk: r.status for r in health.link_history(samples, link, usage=health.link_usage(counters, link, bucket="1 DAY"), **span).collect()}
    assert got[1] == "unhealthy" and got[2] == "disabled"


def test_dead_runs(spark):
    link = links(spark, [(1, "a", "activated", 100.0, 1e9, "WAN", 1, 2)])
    dead = [0, 1, 1, 0, 1, 0, 1, 1, 1, 1]
    samples = spark.createDataFrame([(1, DAY + datetime.timedelta(hours=k), 10.0, bool(d)) for k, d in enumerate(dead)], "link_pk long, event_ts timestamp, rtt_us double, loss boolean")
    got = health.link_history(samples, link, start=F.lit(DAY), end=F.lit(DAY + datetime.timedelta(hours=10)), bucket="1 HOUR", dead_buckets=2).orderBy("bucket").collect()
    assert ["dead" in r.reasons for r in got] == [False, True, True, False, False, False, True, True, True, True]


@pytest.mark.parametrize("counts,want", [((40, 40, 40), "degraded"), ((100, 0, 0), "unhealthy"), ((0, 0, 100), "unhealthy"), ((0, 99, 0), "degraded"), ((0, 0, 0), "healthy")])
def test_devices_by_their_worst_count(spark, counts, want):
    counters = spark.createDataFrame([(1, DAY, *counts)], "device_pk long, event_ts timestamp, errors long, discards long, carrier long")
    devices = spark.createDataFrame([(1, "activated")], "device_pk long, status string")
    assert health.device_history(counters, devices, bucket="day").first().status == want


@pytest.mark.parametrize(
    "bad,worn,loss,want",
    [(11, 0, 0.0, "unhealthy"), (10, 0, 0.0, "degraded"), (1, 0, 50.0, "degraded"), (0, 21, 0.0, "degraded"), (0, 20, 0.0, "healthy"), (0, 0, 10.0, "unhealthy"), (0, 0, 1.0, "degraded"), (0, 0, 0.9, "healthy"), (0, 0, None, "healthy")],
)
def test_verdict(spark, bad, worn, loss, want):
    rows = ["unhealthy"] * bad + ["degraded"] * worn + ["no_data"] * 5
    link = spark.createDataFrame([(s,) for s in rows + ["healthy"] * (100 - len(rows))], "status string")
    got = health.network_status(link, link.limit(3), spark.createDataFrame([(loss,)], "loss_pct double")).collect()
    assert {r.verdict for r in got} == {want} and sum(r.n for r in got if r.kind == "link") == 100
