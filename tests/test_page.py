"""A page of the feed makes no feed that ends before it, and misses no row of those that don't."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.operators import timeline

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, category string, kind string, entity string, severity string"


def rows(category, days):
    return [(DAY + dt.timedelta(days=d), category, "k", f"{category}{i}", "info") for i, d in enumerate(days)]


@pytest.fixture(scope="module")
def feeds():
    return {"a": rows("a", [9, 8, 8, 5, 1]), "b": rows("b", [8, 7, 3]), "c": rows("c", [5, 5]), "d": rows("d", [4] * 5), "e": []}


@pytest.mark.parametrize("limit, offset, made", [(3, 0, "ab"), (2, 2, "ab"), (3, 3, "abc"), (3, 4, "abc"), (20, 0, "abcde"), (4, 100, "abcde")])
def test_page(spark, feeds, limit, offset, made):
    asked = []

    def one(name):
        df = spark.createDataFrame(feeds[name], SCHEMA)

        def make(since):
            asked.append(name)
            wrong = spark.createDataFrame(rows("wrong", [-1]), SCHEMA)
            return df if since is None else df.filter(F.col("ts") >= since).unionByName(wrong)

        return df.agg(F.max("ts")), make

    got = timeline.feed_page([one(k) for k in "dcbae"], limit, offset).collect()
    all_ = timeline.with_id(spark.createDataFrame([x for f in feeds.values() for x in f], SCHEMA)).collect()
    want = sorted(all_, key=lambda r: (-r.ts.timestamp(), r.event_id, r.category, r.severity))
    assert got == want[offset : offset + limit]
    assert "".join(sorted(asked)) == made


def test_page_without_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timeline.feed_page([(none.agg(F.max("ts")), lambda since: none)], 5, 0).count() == 0
