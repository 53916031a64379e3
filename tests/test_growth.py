"""How many rows queries move, by Spark's own metrics."""

import duckdb
import pytest

from strandline.plans.registry import QUERIES


def rows_out(spark, run):
    """Output rows of all operators in whatever run() executes."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, runs = [], store.executionsList()
    for k in range(before, runs.size()):
        number = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for i in range(nodes.size()):
            metrics = nodes.apply(i).metrics()
            for j in range(metrics.size()):
                value = values.get(metrics.apply(j).accumulatorId())
                if metrics.apply(j).name() == "number of output rows" and value.isDefined():
                    found.append(int(value.get().replace(",", "")))
    return found


def one_nation(folder, n):
    """n customers and n suppliers in one nation; two line items for each."""
    tables = {
        "customer": "i AS c_custkey, 'c' || i AS c_name, 7 AS c_nationkey, 5.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment",
        "supplier": "i AS s_suppkey, 's' || i AS s_name, 7 AS s_nationkey",
        "orders": "i AS o_orderkey, i AS o_custkey",
        "lineitem": "i // 2 AS l_orderkey, i // 2 AS l_suppkey",
    }
    for name, columns in tables.items():
        count = 2 * n if name == "lineitem" else n
        duckdb.sql(f"COPY (SELECT {columns} FROM range({count}) r(i)) TO '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["addition_gains", "top_device_utilization"])
def test_a_nation_is_no_product(spark, tmp_path, name):
    """Customers and suppliers of one nation don't meet in pairs."""
    data = one_nation(tmp_path, 1400)
    assert max(rows_out(spark, QUERIES[name](spark, data).collect)) <= 8 * 1400


#: On the smallest tables, whose spine has 61,345 instants.
LIMITS = {
    "stake_history": 1_250_000, "stake_overview": 1_200_000, "share_walkback": 1_000_000, "stake_attribution": 300_000, "stake_changes": 100_000, "stake_changes_summary": 100_000,
    "validator_join_leave_events": 240_000, "validator_connections": 240_000, "validator_disconnections": 200_000, "validators_on_net": 100_000,
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_stake_moves_few_rows(spark, name):
    """Histories are joined once, under few levels, and only what holds at the times that are asked for."""
    assert sum(rows_out(spark, QUERIES[name](spark, "/root/testdata/sf0.001").collect)) <= LIMITS[name]


def test_a_year_of_attribution_moves_few_rows(spark):
    """What moved the connected total in a time span is found from the connections of that span, with the same rows."""
    from pyspark.sql import functions as F

    from strandline.plans import stake_queries
    from strandline.plans.base import Tables, ts

    t = Tables(spark, "/root/testdata/sf0.001")
    start, end = ts("1995-01-01"), ts("1996-01-01")
    inside = lambda df: sorted(map(tuple, df.filter((F.col("t") >= start) & (F.col("t") < end)).collect()))
    found = []
    all_moved = sum(rows_out(spark, lambda: found.append(inside(stake_queries._attribution(t)))))
    moved = sum(rows_out(spark, lambda: found.append(inside(stake_queries._attribution(t, since=start - F.expr("INTERVAL 2 HOURS"), until=end)))))
    assert found[0] == found[1] and found[0]
    assert moved <= 0.6 * all_moved, (moved, all_moved)
