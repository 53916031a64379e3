"""Few pairs and links stay in few partitions, with the same results as many."""

import random

import pytest

from strandline.llm import similar
from strandline.llm.components import components


@pytest.mark.parametrize("few", [0, 5, 1000])
def test_few_edges_meet_in_one_task_and_more_in_rounds(spark, few):
    r = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(7, 7), (None, 3), (400, 401), (401, 400), (401, 400)]
    r.shuffle(edges)
    least = {k: k for e in edges if None not in e and e[0] != e[1] for k in e}
    for _ in least:
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(7), few=few)
    assert sorted((x.node, x.root) for x in found.collect()) == sorted(least.items())
    assert few < 1000 or found.rdd.getNumPartitions() == 1
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_few_pairs_are_read_in_few_partitions(spark, small, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", small)
    texts = [(k, " ".join(f"w{k // 2}-{i}" for i in range(30)) + f" end{k}") for k in range(40)]
    pairs = [(k, k + 1) for k in range(39)] * 2
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = similar.alike(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "node long, text string"), 5, 0.8)
        assert sorted((x.a, x.b) for x in found.collect()) == [(k, k + 1) for k in range(0, 39, 2)]
        assert found.rdd.getNumPartitions() == (1 if small else 13)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
