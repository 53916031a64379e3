"""The registered queries that have SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from strandline.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == order
    at = [rel.columns.index(c) for c in order]
    assert sorted("|".join(plain(r[c]) for c in order) for r in df.collect()) == sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall())
