"""Graph questions on small graphs, against plain Python."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.operators.bridges import bridges

EDGES = "src int, dst int, metric long, bandwidth long"


def table(spark, edges):
    return spark.createDataFrame([(a, b, m, 10) for a, b, m in edges], EDGES)


def sources(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "src int")


def simple_paths(edges, a, b, nodes):
    cost = {(x, y): m for x, y, m in edges}
    rest = [n for n in nodes if n not in (a, b)]
    out = []
    for k in range(len(rest) + 1):
        for mid in permutations(rest, k):
            p = [a, *mid, b]
            if all(s in cost for s in zip(p, p[1:], strict=False)):
                out.append((sum(cost[s] for s in zip(p, p[1:], strict=False)), len(p) - 1, p))
    return sorted(out)


@pytest.fixture(scope="module")
def small():
    r = random.Random(2)
    return [(a, b, r.randrange(1, 9)) for a in range(6) for b in range(6) if a != b and r.random() < 0.6]


def test_paths_of_any_length(spark):
    e = table(spark, [(i, i + 1, 1) for i in range(20)])
    got = {r.dst: (r.cost, r.hops) for r in graph.best_paths(e, sources(spark, [0])).collect()}
    assert got == {i: (i, i) for i in range(21)}
    assert {r.dst for r in graph.reachable(e, sources(spark, [0]), 3).collect()} == {0, 1, 2, 3}


def test_k_shortest_against_all_simple_paths(spark, small):
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src int, dst int")
    got = {(r.src, r.dst, r.n): (r.cost, r.hops, list(r.path)) for r in graph.ranked_paths(table(spark, small), pairs, k=4).collect()}
    want = {(a, b, n): p for a in range(6) for b in range(6) if a != b for n, p in enumerate(simple_paths(small, a, b, range(6))[:4], 1)}
    assert got == want


def test_what_if_links_and_nodes_fail(spark, small):
    e = table(spark, small)
    base = graph.best_paths(e, sources(spark, range(6)))
    cases = spark.createDataFrame([("link", 0, 1), ("node", 2, None)], "scenario string, a int, b int")
    link = cases.filter("b IS NOT NULL").select("scenario", *graph.scenario(edges=[(F.col("a"), F.col("b"))]))
    node = cases.filter("b IS NULL").select("scenario", *graph.scenario(nodes=[F.col("a")]))
    regions = spark.createDataFrame([(n, n // 3) for n in range(6)], "node int, region int")
    both = link.unionByName(node)
    got = {r.scenario: r for r in graph.impact(both, graph.affected_pairs(e, base, both), regions).collect()}
    for name, left, nodes in (("link", [x for x in small if {x[0], x[1]} != {0, 1}], range(6)), ("node", [x for x in small if 2 not in x[:2]], [0, 1, 3, 4, 5])):
        cut = longer = added = 0
        for a, b in permutations(nodes, 2):
            before, after = simple_paths(small, a, b, range(6)), simple_paths(left, a, b, range(6))
            if before:
                cut += not after
                longer += bool(after) and after[0][0] > before[0][0]
                added += after[0][0] - before[0][0] if after else 0
        assert (got[name].n_cut, got[name].n_longer, got[name].added_cost) == (cut, longer, added)
    assert got["node"].n_affected >= got["node"].n_cut and got["link"].n_regions <= 2


def test_regions_with_one_way_out(spark):
    # Region 0 leaves by node 1 alone, though over three links; region 1 by 3, 4 and 5; region 2 by 6 alone.
    e = table(spark, [(0, 1, 1), (1, 3, 1), (1, 4, 1), (1, 5, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (0, 2, 1), (1, 2, 1)])
    regions = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)], "node int, region int")
    got = {tuple(r) for r in graph.redundancy(e, regions).collect()}
    assert got == {("leaf", "6", "critical"), ("link", "5-6", "critical"), ("region", "0", "warning"), ("region", "2", "warning")}


def test_region_matrix_is_symmetric_and_takes_least_hops(spark):
    e = table(spark, [(0, 1, 9), (1, 0, 9), (0, 2, 1), (2, 1, 1)])
    n = sources(spark, range(3))
    regions = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "node int, region int")
    got = {(r.from_region, r.to_region): (r.min_hops, r.min_metric) for r in graph.region_matrix(graph.best_paths(e, n), graph.best_paths(e, n, cost="hops"), graph.best_paths(e, n, cost="bottleneck"), regions).collect()}
    assert got == {(0, 1): (1, 2), (0, 2): (1, 1), (1, 2): (1, 1)}


def parts(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    return len({find(n) for n in nodes})


@pytest.mark.parametrize("n,m,seed", [(12, 12, 1), (30, 34, 2), (40, 30, 3), (9, 30, 4)])
def test_bridges_against_removal_of_each_link(spark, n, m, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    rows = [(*(p if r.random() < 0.5 else p[::-1]), 1, 1) for p in pairs] + [(0, 0, 1, 1)]
    rows += [rows[0], (rows[1][1], rows[1][0], 5, 1)]
    nodes = {x for p in pairs for x in p}
    want = {p for p in pairs if parts(pairs - {p}, nodes) > parts(pairs, nodes)}
    assert {tuple(x) for x in bridges(spark.createDataFrame(rows, EDGES)).collect()} == want


def test_bridges_of_a_long_path_and_of_nothing(spark):
    rows = [(i, i + 1, 1, 1) for i in range(40)] + [(7, 9, 1, 1)]
    got = {tuple(x) for x in bridges(spark.createDataFrame(rows, EDGES)).collect()}
    assert got == {(i, i + 1) for i in range(40)} - {(7, 8), (8, 9)}
    assert bridges(spark.createDataFrame([], EDGES)).count() == 0


def test_repair_gives_the_paths_of_a_new_search(spark):
    r = random.Random(6)
    rows = [(a, b, r.randrange(1, 9)) for a in range(14) for b in range(14) if a != b and r.random() < 0.22]
    e = table(spark, rows)
    base = graph.best_paths(e, sources(spark, range(14)))
    cases = spark.createDataFrame([(f"{a}-{b}", a, b, n) for a, b, n in [(0, 1, 2), (3, 4, 5), (6, 7, None), (8, 9, 10), (11, 12, 0)]], "scenario string, a int, b int, n int")
    cases = cases.select("scenario", F.expr("IF(n IS NULL, array(), array(n))").cast(graph.NO_NODES).alias("no_nodes"), graph.scenario(edges=[(F.col("a"), F.col("b"))])[1])
    again = {(x.scenario, x.src, x.dst): (x.cost, list(x.path)) for x in graph.best_paths(e, sources(spark, range(14)), scenarios=cases).collect()}
    old = {(x.src, x.dst): (x.cost, list(x.path)) for x in base.collect()}
    got = {(x.scenario, x.src, x.dst): x for x in graph.affected_pairs(e, base, cases).collect()}
    assert got
    for k, x in got.items():
        assert (x.before, list(x.path)) == old[k[1:]] and ((x.after, list(x.way)) if x.way else None) == again.get(k)
    for k, v in again.items():
        assert k in got or v == old[k[1:]]


def test_equal_hop_paths(spark, small):
    steps = graph.predecessors(table(spark, small), sources(spark, range(6)))
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if a != b], "src int, dst int")
    got = {}
    for x in graph.equal_hop_paths(steps, pairs).collect():
        got.setdefault((x.src, x.dst), []).append(list(x.path))
        assert x.hops == len(x.path) - 1
    for a, b in permutations(range(6), 2):
        ways = [p for _, h, p in simple_paths(small, a, b, range(6))]
        least = min(map(len, ways), default=0)
        assert sorted(got.get((a, b), [])) == sorted(p for p in ways if len(p) == least)
    assert all(x.n_paths == len(got[x.src, x.node]) for x in steps.collect())


def test_new_links_make_leaves_redundant(spark):
    e = table(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (4, 3, 1), (5, 0, 1)])
    cases = spark.createDataFrame([("x", 4, 0), ("y", 4, 3), ("z", 5, 4), ("w", 1, 3)], "scenario string, a int, b int")
    assert {tuple(r) for r in graph.redundancy_gains(e, cases).collect()} == {("x", 4), ("z", 5), ("z", 4)}
