"""As-of joins cut into parts, quantile sketches, longest prefixes, and the current state beside its log."""

import datetime
import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import addresses, sketches
from strandline.operators import geo, joins, scd2, state_table

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_asof_of_a_hot_key_over_parts(spark, reuse):
    r = random.Random(4)
    key = lambda: r.choice(["hot"] * 5 + ["a", "b", None])
    left = [(key(), at(r.randrange(500)), i) for i in range(400)]
    right = [(key(), at(r.randrange(500)), f"r{i:03}") for i in range(120)] + [("hot", at(3), "r000")]
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        l, rr = spark.createDataFrame(left, "k string, t timestamp, n int"), spark.createDataFrame(right, "k string, t timestamp, v string")  # noqa: E741
        got = {x.n: x.v for x in joins.asof_join(l, rr, ["k"], "t", "t", ["v"], part_rows=40).select("n", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = {n: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(None, None))[1] for k, t, n in left}
    assert got == want


def test_sketches_merge_and_keep_their_error(spark):
    r = random.Random(5)
    values = [r.choice([r.random(), r.random() * 1000, r.lognormvariate(5, 3)]) for _ in range(3000)]
    df = spark.createDataFrame([(i % 7, i % 3, v) for i, v in enumerate(values)], "hour int, k int, v double")
    fine = sketches.sketch(df, ["hour", "k"], F.col("v"), scale=1000.0)
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for x in sketches.quantiles(fine, ["k"], shares, scale=1000.0).collect():
        own = sorted(round(v * 1000) for i, v in enumerate(values) if i % 3 == x.k)
        assert x.n == len(own)
        for name, q in shares.items():
            exact = own[max(math.ceil(q * len(own)), 1) - 1] / 1000
            assert exact * (1 - 2**-sketches.BITS) - 1e-9 <= x[name] <= exact + 1e-9
    whole = sketches.sketch(df, ["k"], F.col("v"), scale=1000.0)
    both = [sorted(map(tuple, s.collect())) for s in (whole.select("k", "low", "n"), sketches.merged(fine, ["k"]).select("k", "low", "n"))]
    assert both[0] == both[1]
    assert sketches.quantiles(sketches.sketch(df.limit(0), ["k"], F.col("v")), ["k"], shares).count() == 0


ADDRESSES = ["10.0.0.1", "10.1.2.3", "192.168.1.77", "0.0.0.0", "255.255.255.255", "::", "::1", "2001:db8::1", "2001:db8:0:1::", "fe80::1:2:3", "2001:0DB8:0000:0000:0000:0000:0000:00ff", "1:2:3:4:5:6:7:8"]
WRONG = [None, "", "10.0.0", "256.1.1.1", "1:2:3", "::1::2", "1:2:3:4:5:6:7:8:9", "g::1", "host", "1:2:3:4:5:6:7::8"]


def number(ip):
    a = ipaddress.ip_address(ip)
    return int(a) if a.version == 6 else (0xFFFF << 32) + int(a)


def test_bits_of_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES + WRONG[:-1]], "ip string")
    got = {r.ip: r.b for r in df.select("ip", addresses.bits(F.col("ip")).alias("b")).collect()}
    assert {a: got[a] for a in ADDRESSES} == {a: f"{number(a):0128b}" for a in ADDRESSES}
    assert all(got[w] is None for w in WRONG[:-1])


def test_longest_prefix_of_both_kinds(spark):
    r = random.Random(6)
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "192.168.1.64/27", "2001:db8::/32", "2001:db8:0:1::/64", "::/0", "not a net", "10.0.0.0/99"]
    asked = ADDRESSES + [f"10.{r.randrange(3)}.{r.randrange(4)}.{r.randrange(5)}" for _ in range(60)] + [f"2001:db8:0:{r.randrange(3)}::{r.randrange(9)}" for _ in range(20)] + WRONG
    ips = spark.createDataFrame([(a,) for a in asked], "ip string")
    table = spark.createDataFrame([(n, i) for i, n in enumerate(nets)], "network string, place int")
    got = {x.ip: x.place for x in geo.longest_prefix(ips, table).collect()}

    def bits_of(n):
        net = ipaddress.ip_network(n)
        return f"{number(str(net.network_address)):0128b}"[: net.prefixlen + (96 if net.version == 4 else 0)]

    known = {bits_of(n): i for i, n in enumerate(nets[:8])}
    for a in set(asked) - set(WRONG):
        own = f"{number(a):0128b}"
        assert got.get(a) == next((known[own[:n]] for n in range(128, -1, -1) if own[:n] in known), None), a
    assert not set(got) & set(WRONG)
    feeds = geo.addresses([ips, ips.limit(5)])
    assert feeds.count() == len({a for a in asked if a not in WRONG})


def test_upsert_deletes_nothing(spark):
    old, new = spark.createDataFrame([("a", 1), ("b", 9)], "ip string, place int"), spark.createDataFrame([("b", 2), ("c", 3)], "ip string, place int")
    assert sorted(map(tuple, geo.upsert(old, new, "ip").collect())) == [("a", 1), ("b", 2), ("c", 3)]


SCHEMA = "entity_id string, snapshot_ts timestamp, ingested_at timestamp, op_id long, is_deleted boolean, level long"


def test_state_is_the_same_with_and_without_snapshots(spark, tmp_path):
    r = random.Random(7)
    plain, kept, root = [], str(tmp_path / "kept"), None
    bare = str(tmp_path / "bare")
    for part in range(5):
        rows = [(f"e{r.randrange(12)}", at(part * 100 + i), at(part * 100 + i), part * 100 + i, r.random() < 0.2, r.randrange(4)) for i in range(15)]
        plain += rows
        for root in (kept, bare):
            state_table.append(spark.createDataFrame(rows, SCHEMA), root, part)
        if part in (1, 3):
            state_table.compact(spark, kept, SCHEMA)
        whole = scd2.latest(spark.createDataFrame(plain, SCHEMA))
        want = sorted(map(tuple, whole.collect()))
        assert sorted(map(tuple, state_table.latest_rows(spark, kept, SCHEMA).collect())) == want
        assert sorted(map(tuple, state_table.latest_rows(spark, bare, SCHEMA).collect())) == want
    snapshot = spark.createDataFrame([(f"e{i}", at(900), at(900), 900 + i, False, 2) for i in range(3, 15)], SCHEMA)
    args = {"at": F.lit(at(1000)), "op_id": F.lit(1000).cast("long"), "missing_means_deleted": True}
    want = scd2.delta(spark.createDataFrame(plain, SCHEMA), snapshot, ["level"], **args)
    got = state_table.delta(spark, kept, SCHEMA, snapshot, ["level"], **args)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()
    # A repeated part and a repeated compaction change nothing; the log before the snapshot is not read.
    state_table.compact(spark, kept, SCHEMA)
    files = [f for f in state_table.latest_rows(spark, kept, SCHEMA).inputFiles() if "/log/" in f]
    assert not files or spark.read.parquet(f"{kept}/log").filter("part > 4").count() == 0
