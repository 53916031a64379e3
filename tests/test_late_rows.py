"""Late rows: blocks follow the number of rows, not the unit of arrival."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandline.streaming import streams


def test_blocks_hold_many_rows_and_late_rows_are_exact(spark):
    t0 = datetime(2024, 1, 1)
    data = [(i, t0 + timedelta(minutes=i - (600 if i % 13 == 0 else 0)), i * 1_000_000) for i in range(3000)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp, arrival long").repartition(5, "event_id")
    sizes = [r.n for r in streams.arrival_blocks(df, "arrival", 500).groupBy("block").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3000 and 2 <= len(sizes) <= 6
    want, newest = {}, None
    for i, ts, _ in data:
        if newest and ts < newest - timedelta(hours=6):
            want[i] = newest
        newest = max(newest or ts, ts)
    for block_rows in (500, 100_000):
        got = {r.event_id: r.newest for r in streams.late_rows(df, "ts", "arrival", "6 HOURS", block_rows=block_rows).collect()}
        assert got == want
