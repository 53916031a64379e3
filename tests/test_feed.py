"""Filters of the feed: classes of actions, connection and stake."""

import pytest

from strandline.operators import timeline

SCHEMA = "ts int, category string, kind string, entity string, severity string"
ROWS = [
    (1, "validator", "validator_joined", "a", "info"), (2, "validator", "validator_stake_increased", "a", "info"), (3, "validator", "validator_stake_decreased", "b", "warning"),
    (4, "gossip_node", "gossip_node_left", "c", "warning"), (5, "link", "link_updated", "a", "info"), (6, "packet_loss", "packet_loss_recovered", None, "success"), (7, "validator", "validator_stake_changed", None, "info"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def when(df):
    return sorted(r.ts for r in df.collect())


@pytest.mark.parametrize("actions, want", [([], [1, 2, 3, 4, 5, 6, 7]), (["added"], [1]), (["removed", "changed"], [4, 5, 7]), (["alerting"], [2]), (["resolved"], [3, 6]), (["unknown"], [])])
def test_by_action(events, actions, want):
    assert when(timeline.by_action(events, actions)) == want


def test_by_network(spark, events):
    nodes = spark.createDataFrame([("a", 10.0, True), ("b", 5.0, None)], "entity string, stake double, is_on boolean")
    assert when(timeline.by_network(events, nodes, on=True)) == [1, 2, 4, 5, 6]
    assert when(timeline.by_network(events, nodes, on=False)) == [3, 5, 6, 7]
    assert when(timeline.by_network(events, nodes, least_stake=6.0)) == [1, 2, 5, 6]
    assert when(timeline.by_network(events, nodes.limit(0))) == [1, 2, 3, 4, 5, 6, 7]
