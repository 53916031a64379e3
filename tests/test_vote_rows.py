"""Votes: the last entry of a list is found without gathering a user's events."""

from strandline.plans.registry import QUERIES


def test_no_events_are_gathered(spark):
    plan = QUERIES["vote_activity_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "max(array(" in plan
