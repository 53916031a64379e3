"""Every registered query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"k_shortest_paths", "bridge_links"}  # see test_graph


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in order) for r in df.collect())
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall())
