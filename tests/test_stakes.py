"""Stake queries on small tables of odd cases, against their SQL."""

import datetime as dt

import duckdb
import pytest

from strandline.plans.registry import ORACLES, QUERIES


def rows_of(spark, folder, name, tables):
    """What the query and its SQL give on tables: (columns with types, rows) by name."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for table, (schema, rows) in tables.items():
        con.sql(f"CREATE TABLE {table} ({schema})")
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.sql(f"COPY {table} TO '{folder}/{table}.parquet'")
    df, rel = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    return sorted(map(str, map(tuple, df.collect()))), sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["stake_change_events", "stake_events"])
def test_changes_from_no_stake(spark, tmp_path, name):
    day = lambda d: dt.datetime(2024, 1, d)
    values = [(1, 6, 0.0), (1, 7, 36.2), (1, 8, 0.0), (1, 9, 300.0), (2, 6, 10.0), (2, 7, 70.0), (2, 8, 71.0)]
    events = [(k, day(d), user, "view", value) for k, (user, d, value) in enumerate(values)]
    got, wanted = rows_of(spark, tmp_path, name, {"events": ("event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE", events)})
    assert got == wanted and len(got) == 2  # 0 to 300, and 10 to 70
