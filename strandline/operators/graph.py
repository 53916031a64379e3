"""Graph questions as joins over edge tables (src, dst, metric, bandwidth), for all sources and scenarios at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable

#: What a path costs, from the path so far and the next edge; the least wins, then fewer hops, then the smaller path.
COSTS = {
    "hops": lambda cost, e: cost + F.lit(1).cast("long"),
    "metric": lambda cost, e: cost + F.col(f"{e}.metric"),
    # The widest path: minus the least bandwidth on it.
    "bottleneck": lambda cost, e: F.greatest(cost, -F.col(f"{e}.bandwidth").cast("long")),
}
START = {"hops": 0, "metric": 0, "bottleneck": -(2**62)}


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    return both.groupBy("src", "dst").agg(F.min("metric").alias("metric"), F.max("bandwidth").alias("bandwidth"))


def adjacency(lsdb: DataFrame, links: DataFrame) -> DataFrame:
    """Directed edges from link-state neighbours (src, neighbor_addr, metric): the link whose /31 pair has the address gives
    the other end; drained links give none. links: a_pk, z_pk, a_addr, z_addr, status, bandwidth."""
    live = links.filter("status = 'activated'")
    ends = live.select(F.col("z_addr").alias("neighbor_addr"), F.col("z_pk").alias("dst"), "bandwidth").unionByName(
        live.select(F.col("a_addr").alias("neighbor_addr"), F.col("a_pk").alias("dst"), "bandwidth")
    )
    return lsdb.join(ends, "neighbor_addr").select("src", "dst", "metric", "bandwidth")


def degree(edges: DataFrame) -> DataFrame:
    """(node, n): distinct neighbours in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("n"))


def adjacency_list(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_set("dst")), lambda x: x.cast("string")), ",").alias("neighbors"))


NO_NODES, NO_EDGES = "array<int>", "array<struct<src:int,dst:int>>"


def scenario(nodes: list[Column] | None = None, edges: list[tuple[Column, Column]] | None = None) -> list[Column]:
    """What a scenario leaves out: nodes, and edges in both directions."""
    both = [F.struct(x.cast("int").alias("src"), y.cast("int").alias("dst")) for a, b in edges or [] for x, y in ((a, b), (b, a))]
    return [F.array(*(nodes or [])).cast(NO_NODES).alias("no_nodes"), F.array(*both).cast(NO_EDGES).alias("no_edges")]


def best_paths(edges: DataFrame, sources: DataFrame, *, cost: str = "metric", max_hops: int | None = None, scenarios: DataFrame | None = None) -> DataFrame:
    """(scenario, src, dst, cost, hops, path): the best path from each source (column src) to each node it reaches.

    scenarios: (scenario, no_nodes, no_edges), see scenario(), with or without a column src; with it, each has sources of its own
    and `sources` isn't asked. All sources and scenarios are relaxed together, one join a round; a round keeps the best row of each
    (scenario, source, node), in the shared folder, until nothing changes: paths are simple, so that is at most one round a
    node. max_hops, where given, is part of the question.
    """
    if scenarios is None:
        begin = sources.select(F.lit(0).alias("scenario"), *scenario(), "src")
    elif "src" in scenarios.columns:
        begin = scenarios
    else:
        begin = scenarios.crossJoin(sources.select("src"))  # the result has a row for each
    begin = begin.filter(~F.array_contains("no_nodes", F.col("src").cast("int")))
    start = F.struct(F.lit(START[cost]).cast("long").alias("cost"), F.lit(0).alias("hops"), F.array("src").alias("path"))
    best = durable(begin.select("scenario", "src", F.col("src").alias("node"), "no_nodes", "no_edges", start.alias("p"), F.lit(True).alias("fresh")))
    e, rounds = edges.alias("e"), 0
    while (max_hops is None or rounds < max_hops) and not best.filter("fresh").isEmpty():
        rounds += 1
        step = best.filter("fresh").alias("b").join(e, F.col("b.node") == F.col("e.src"))
        used = F.struct(F.col("e.src").cast("int").alias("src"), F.col("e.dst").cast("int").alias("dst"))
        allowed = ~F.array_contains("no_nodes", F.col("e.dst").cast("int")) & ~F.array_contains("no_edges", used) & ~F.array_contains("p.path", F.col("e.dst"))
        grown = F.struct(COSTS[cost](F.col("p.cost"), "e").alias("cost"), (F.col("p.hops") + 1).alias("hops"), F.concat("p.path", F.array("e.dst")).alias("path"))
        step = step.filter(allowed).select("scenario", "b.src", F.col("e.dst").alias("node"), "no_nodes", "no_edges", grown.alias("p"), F.lit(True).alias("fresh"))
        both = best.withColumn("fresh", F.lit(False)).unionByName(step)
        chosen = both.groupBy("scenario", "src", "node").agg(F.min(F.struct("p", "fresh")).alias("m"), F.first("no_nodes").alias("no_nodes"), F.first("no_edges").alias("no_edges"))
        best = durable(chosen.select("scenario", "src", "node", "no_nodes", "no_edges", "m.p", "m.fresh"))
    return best.select("scenario", "src", F.col("node").alias("dst"), "p.cost", "p.hops", "p.path")


def reachable(edges: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(src, dst, hops) within max_hops of each source, the source itself included."""
    return best_paths(edges, sources, cost="hops", max_hops=max_hops).select("src", "dst", "hops")


def subgraph(edges: DataFrame, centers: DataFrame, hops: int) -> DataFrame:
    """Edges between nodes that lie within some hops of a center, in any direction."""
    near = reachable(undirected(edges), centers, hops).select(F.col("src").alias("center"), F.col("dst").alias("node"))
    a, b = near.withColumnRenamed("node", "src"), near.withColumnRenamed("node", "dst")
    return edges.select("src", "dst", "metric").join(a, "src").join(b, ["center", "dst"]).select("center", "src", "dst", "metric")


def hops_of(paths: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each path hop by hop, with its edge and the metric so far."""
    pairs = F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS a, path[i] AS b))")
    rows = paths.filter("hops > 0").select(*keys, F.posexplode(pairs).alias("hop", "x")).select(*keys, "hop", "x.*")
    rows = rows.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "metric", "bandwidth"), ["a", "b"])
    w = Window.partitionBy(*keys).orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_metric", F.sum("metric").over(w))


def link_figures(links: DataFrame, latency: DataFrame) -> DataFrame:
    """(a, b, rtt_us, jitter_us, n_samples, bandwidth_bps, n_drained): what is known of the links between two nodes, in both directions.

    links: link_pk, side_a, side_z, bandwidth_bps, status; latency: link_pk, rtt_us, loss, ipdv_us. Lost samples have no round trip.
    """
    good = latency.filter("NOT loss AND rtt_us > 0").groupBy("link_pk").agg(F.sum("rtt_us").alias("s"), F.count("*").alias("n"), F.sum("ipdv_us").alias("j"), F.count("ipdv_us").alias("nj"))
    both = links.select("link_pk", F.col("side_a").alias("a"), F.col("side_z").alias("b"), "bandwidth_bps", "status")
    both = both.unionByName(both.withColumns({"a": F.col("b"), "b": F.col("a")})).filter("a <> b").join(good, "link_pk", "left")
    return both.groupBy("a", "b").agg(
        (F.sum("s") / F.sum("n")).alias("rtt_us"), (F.sum("j") / F.nullif(F.sum("nj"), F.lit(0))).alias("jitter_us"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"),
        F.sum("bandwidth_bps").alias("bandwidth_bps"), F.count_if(F.col("status") != "activated").alias("n_drained"),
    )


def region_paths(edges: DataFrame, sources: DataFrame, regions: DataFrame, mode: str) -> DataFrame:
    """(mode, from_region, to_region, cost, hops, path): the best path between any two nodes of two regions. mode: 'hops', 'latency' (least
    metric) or 'bandwidth' (widest; cost is the width). regions: node, region."""
    kind = {"hops": "hops", "latency": "metric", "bandwidth": "bottleneck"}[mode]
    side = lambda c, n: regions.select(F.col("node").alias(c), F.col("region").alias(n))
    rows = best_paths(edges, sources, cost=kind).join(side("src", "from_region"), "src").join(side("dst", "to_region"), "dst").filter("from_region <> to_region")
    best = rows.groupBy("from_region", "to_region").agg(F.min(F.struct("cost", "hops", "path")).alias("p"))
    cost = -F.col("p.cost") if mode == "bandwidth" else F.col("p.cost")
    return best.select(F.lit(mode).alias("mode"), "from_region", "to_region", cost.alias("cost"), "p.hops", "p.path")


def _prefix(path: Column, n: Column) -> Column:
    return F.slice(path, 1, n)


def ranked_paths(edges: DataFrame, pairs: DataFrame, *, k: int) -> DataFrame:
    """(src, dst, n, cost, hops, path): the k best simple paths by metric of each pair (src, dst); ties to fewer hops and the smaller path.

    Each further path leaves a known one at some node: for every such node, the best way on that avoids the nodes before it and the
    steps that known paths with the same beginning take there (Yen 1971). The ways of all pairs and nodes are scenarios of one
    search, so that there are k - 1 searches in all, and k paths a pair are kept.
    """
    pairs = durable(pairs.select("src", "dst").distinct())
    first = best_paths(edges, pairs.select("src").distinct()).join(pairs, ["src", "dst"]).filter("src <> dst")
    known = durable(first.select("src", "dst", F.lit(1).alias("n"), "cost", "hops", "path"))
    waiting = None
    metrics = edges.groupBy("src", "dst").agg(F.min("metric").alias("metric"))
    for n in range(2, k + 1):
        last = known.filter(F.col("n") == n - 1)
        spurs = last.select("src", "dst", "path", F.explode(F.sequence(F.lit(1), F.col("hops"))).alias("at"))
        spurs = spurs.withColumn("root", _prefix(F.col("path"), F.col("at")))
        same = known.select("src", "dst", F.col("path").alias("other"))
        taken = spurs.join(same, ["src", "dst"]).filter(_prefix(F.col("other"), F.col("at")) == F.col("root"))
        step = F.struct(F.get("other", F.col("at") - 1).cast("int").alias("src"), F.get("other", F.col("at")).cast("int").alias("dst"))
        cases = taken.groupBy("src", "dst", "root", "at").agg(F.collect_set(step).alias("no_edges"))
        name = F.struct("src", "dst", "root").alias("scenario")
        cases = cases.select(name, F.slice("root", 1, F.col("at") - 1).cast(NO_NODES).alias("no_nodes"), F.col("no_edges").cast(NO_EDGES).alias("no_edges"), F.element_at("root", -1).alias("src"))
        way = best_paths(edges, pairs, scenarios=cases).filter(F.col("dst") == F.col("scenario.dst"))
        whole = way.select("scenario.src", "scenario.dst", F.concat(F.slice("scenario.root", 1, F.size("scenario.root") - 1), "path").alias("path"))
        steps = whole.distinct().select("src", "dst", "path", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS a, path[i] AS b))")).alias("x"))
        priced = steps.select("src", "dst", "path", "x.*").join(metrics.select(F.col("src").alias("a"), F.col("dst").alias("b"), "metric"), ["a", "b"])
        found = priced.groupBy("src", "dst", "path").agg(F.sum("metric").alias("cost")).select("src", "dst", "cost", (F.size("path") - 1).alias("hops"), "path")
        waiting = durable((found if waiting is None else waiting.unionByName(found)).distinct().join(known.select("src", "dst", "path"), ["src", "dst", "path"], "left_anti"))
        best = waiting.groupBy("src", "dst").agg(F.min(F.struct("cost", "hops", "path")).alias("p"))
        known = durable(known.unionByName(best.select("src", "dst", F.lit(n).alias("n"), "p.cost", "p.hops", "p.path")))
    return known


def compare(configured: DataFrame, adjacency_edges: DataFrame) -> DataFrame:
    """Configured links (a, z, expected metric) against adjacency: missing, one-way, metric off by more than twice, extra, or ok."""
    adj = adjacency_edges.groupBy("src", "dst").agg(F.min("metric").alias("metric"))
    there = adj.select(F.col("src").alias("a"), F.col("dst").alias("z"), F.col("metric").alias("az"))
    back = adj.select(F.col("dst").alias("a"), F.col("src").alias("z"), F.col("metric").alias("za"))
    both = there.join(back, ["a", "z"], "full").select(F.least("a", "z").alias("a"), F.greatest("a", "z").alias("z"), F.when(F.col("a") < F.col("z"), F.col("az")).otherwise(F.col("za")).alias("az"), F.when(F.col("a") < F.col("z"), F.col("za")).otherwise(F.col("az")).alias("za"))
    both = both.groupBy("a", "z").agg(F.min("az").alias("az"), F.min("za").alias("za"))
    rows = configured.join(both, ["a", "z"], "full")
    off = F.coalesce("az", "za") / F.col("expected")
    state = (
        F.when(F.col("expected").isNull(), "extra")
        .when(F.col("az").isNull() & F.col("za").isNull(), "missing")
        .when(F.col("az").isNull() | F.col("za").isNull(), "one_way")
        .when((off < 0.5) | (off > 2), "metric")
        .otherwise("ok")
    )
    return rows.select("a", "z", "expected", "az", "za", state.alias("state"))


def affected_pairs(edges: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, src, dst, before, after, path, way): ordered pairs whose best path uses what a scenario leaves out, with the cost before and
    after, null where they are cut. base: best_paths() of all sources. Pairs of a node that is left out don't count.

    All other pairs keep their path and cost. The affected part of each source's tree is repaired from its border (repaired()).
    way: the path before and after.
    """
    paths = base.filter("src <> dst").select("src", "dst", F.col("cost").alias("before"), "path")
    nodes = paths.select("src", "dst", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("node"))
    steps = paths.select("src", "dst", F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS src, path[i] AS dst))")).alias("step"))
    by_node = scenarios.select("scenario", F.explode("no_nodes").alias("node")).join(nodes, "node").select("scenario", "src", "dst")
    by_edge = scenarios.select("scenario", F.explode("no_edges").alias("x")).join(steps, F.col("x") == F.col("step").cast("struct<src:int,dst:int>")).select("scenario", "src", "dst")
    hit = durable(by_node.unionByName(by_edge).distinct().join(scenarios, "scenario").filter(~F.array_contains("no_nodes", F.col("src").cast("int")) & ~F.array_contains("no_nodes", F.col("dst").cast("int"))))
    after = repaired(edges, base, hit).select("scenario", "src", "dst", F.col("cost").alias("after"), F.col("path").alias("way"))
    return hit.select("scenario", "src", "dst").join(paths, ["src", "dst"]).join(after, ["scenario", "src", "dst"], "left")


def repaired(edges: DataFrame, base: DataFrame, hit: DataFrame) -> DataFrame:
    """(scenario, src, dst, cost, hops, path): new best paths by metric to the nodes that lost theirs; none where they are cut.

    hit: (scenario, src, dst, no_nodes, no_edges), every pair whose path in base uses what its scenario leaves out. The border are the
    edges that lead from nodes with their old path into these. From there, rounds go on over edges among the hit nodes alone, from those
    that the round before made better; so the work is that of what changes, and not of whole trees.
    """
    key = ["scenario", "src", "node"]
    lost = hit.withColumnRenamed("dst", "node")
    used = F.struct(F.col("u").cast("int").alias("src"), F.col("node").cast("int").alias("dst"))
    into = lost.join(edges.groupBy(F.col("src").alias("u"), F.col("dst").alias("node")).agg(F.min("metric").alias("metric")), "node")
    into = into.filter(~F.array_contains("no_nodes", F.col("u").cast("int")) & ~F.array_contains("no_edges", used)).select(*key, "u", "metric")
    among = into.join(lost.select("scenario", "src", F.col("node").alias("u"), F.lit(True).alias("also")), ["scenario", "src", "u"], "left")
    among = durable(among)
    old = base.select("src", F.col("dst").alias("u"), "cost", "hops", "path")
    grown = F.struct((F.col("cost") + F.col("metric")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("node")).alias("path")).alias("p")
    start = among.filter("also IS NULL").join(old, ["src", "u"]).select(*key, grown)
    fresh = durable(start.groupBy(*key).agg(F.min("p").alias("p")))
    inner, best = among.filter("also").drop("also"), fresh
    while not fresh.isEmpty():
        now = fresh.select("scenario", "src", F.col("node").alias("u"), "p.cost", "p.hops", "p.path")
        step = inner.join(now, ["scenario", "src", "u"]).filter(~F.array_contains("path", F.col("node"))).select(*key, grown)
        found = step.groupBy(*key).agg(F.min("p").alias("q"))
        fresh = durable(found.join(best, key, "left").filter(F.col("p").isNull() | (F.col("q") < F.col("p"))).select(*key, F.col("q").alias("p")))
        best = durable(best.unionByName(fresh).groupBy(*key).agg(F.min("p").alias("p")))
    return best.select("scenario", "src", F.col("node").alias("dst"), "p.cost", "p.hops", "p.path")


def active(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges between nodes (node, status) that are activated."""
    live = nodes.filter("status = 'activated'").select("node").distinct()
    return edges.join(live.withColumnRenamed("node", "src"), "src", "left_semi").join(live.withColumnRenamed("node", "dst"), "dst", "left_semi")


def predecessors(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node, before, hops, n_paths): every edge that lies on some path with the fewest hops from a source, and how many such paths the
    node has from it. n_paths is added up level by level, over all sources at once."""
    far = durable(best_paths(edges, sources, cost="hops").select("src", F.col("dst").alias("node"), "hops"))
    near = far.select("src", F.col("node").alias("before"), F.col("hops").alias("h"))
    pairs = edges.select(F.col("src").alias("before"), F.col("dst").alias("node")).distinct()
    steps = durable(near.join(pairs, "before").join(far, ["src", "node"]).filter(F.col("h") + 1 == F.col("hops")).select("src", "node", "before", "hops"))
    counts = durable(far.filter("hops = 0").select("src", "node", F.lit(1).cast("long").alias("n_paths"), F.lit(True).alias("fresh")))
    out, level = steps.limit(0).withColumn("n_paths", F.lit(0).cast("long")), 0
    while True:
        level += 1
        met = steps.filter(F.col("hops") == level).join(counts.select("src", F.col("node").alias("before"), "n_paths"), ["src", "before"])
        counts = durable(met.groupBy("src", "node").agg(F.sum("n_paths").alias("n_paths")))
        if counts.isEmpty():
            return out
        out = out.unionByName(steps.filter(F.col("hops") == level).join(counts, ["src", "node"]).select(*out.columns))


def equal_hop_paths(steps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, hops, n_paths, path): all paths with the fewest hops of each pair (src, dst), unrolled from predecessors() backwards. A
    pair has n_paths rows; ask for pairs whose n_paths is not too many."""
    ends = steps.select("src", F.col("node").alias("dst"), "hops", "n_paths").distinct().join(pairs.select("src", "dst").distinct(), ["src", "dst"])
    open_ = durable(ends.select("src", "dst", "hops", "n_paths", F.array("dst").alias("path"), F.col("dst").alias("at")))
    done, back = open_.limit(0).drop("at"), steps.select("src", F.col("node").alias("at"), "before")
    while not open_.isEmpty():
        open_ = durable(open_.join(back, ["src", "at"]).select("src", "dst", "hops", "n_paths", F.concat(F.array("before"), "path").alias("path"), F.col("before").alias("at")))
        done = done.unionByName(open_.filter("at = src").drop("at"))
        open_ = open_.filter("at <> src")
    return done


def maintenance(edges: DataFrame, base: DataFrame, items: DataFrame, regions: DataFrame) -> DataFrame:
    """impact() of items of maintenance, nodes and links together, with the place in which to do them: what cuts least first, then what makes
    least longer. items: (scenario, kind, no_nodes, no_edges), see scenario(). One row an item."""
    found = impact(items.select("scenario", "kind"), affected_pairs(edges, base, items.drop("kind")), regions)
    place = F.row_number().over(Window.orderBy("n_cut", "n_longer", "added_cost", "scenario"))
    return items.select("scenario", "kind").join(found, "scenario").withColumn("place", place.cast("long"))


def impact(scenarios: DataFrame, affected: DataFrame, regions: DataFrame) -> DataFrame:
    """Per scenario: pairs affected, cut and longer, the cost added, nodes that some other can't reach any more, and pairs of regions
    between which a path is affected. regions: node, region."""
    side = lambda c, n: regions.select(F.col("node").alias(c), F.col("region").alias(n))
    rows = affected.join(side("src", "from_region"), "src").join(side("dst", "to_region"), "dst")
    longer = F.col("after") > F.col("before")
    sums = rows.groupBy("scenario").agg(
        F.count("*").alias("n_affected"), F.count_if(F.col("after").isNull()).alias("n_cut"), F.count_if(longer).alias("n_longer"),
        F.sum(F.when(longer, F.col("after") - F.col("before")).otherwise(0)).alias("added_cost"), F.count_distinct(F.when(F.col("after").isNull(), F.col("dst"))).alias("n_nodes_cut"),
        F.count_distinct(F.when(F.col("from_region") != F.col("to_region"), F.struct("from_region", "to_region"))).alias("n_regions"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_affected", "n_cut", "n_longer", "added_cost", "n_nodes_cut", "n_regions")}
    return scenarios.select("scenario").join(sums, "scenario", "left").withColumns(zero)


def critical_links(edges: DataFrame) -> DataFrame:
    """Links by the lesser degree of their ends: 1 critical, 2 important, else redundant."""
    d = degree(edges)
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("z")).distinct()
    rows = pairs.join(d.select(F.col("node").alias("a"), F.col("n").alias("a_degree")), "a").join(d.select(F.col("node").alias("z"), F.col("n").alias("z_degree")), "z")
    least = F.least("a_degree", "z_degree")
    return rows.select("a", "z", "a_degree", "z_degree", F.when(least == 1, "critical").when(least == 2, "important").otherwise("redundant").alias("state"))


def redundancy(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(kind, name, severity): leaf nodes, critical links, and regions with one node that has a link out. regions: node, region."""
    leaves = degree(edges).filter("n = 1").select(F.lit("leaf").alias("kind"), F.col("node").cast("string").alias("name"), F.lit("critical").alias("severity"))
    links = critical_links(edges).filter("state = 'critical'").select(F.lit("link").alias("kind"), F.concat_ws("-", "a", "z").alias("name"), F.lit("critical").alias("severity"))
    side = lambda c, n: regions.select(F.col("node").alias(c), F.col("region").alias(n))
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("z")).distinct().join(side("a", "ra"), "a").join(side("z", "rz"), "z").filter("ra <> rz")
    exits = pairs.select(F.col("ra").alias("region"), F.col("a").alias("node")).unionByName(pairs.select(F.col("rz").alias("region"), F.col("z").alias("node")))
    single = exits.groupBy("region").agg(F.count_distinct("node").alias("n")).filter("n = 1")
    single = single.select(F.lit("region").alias("kind"), F.col("region").cast("string").alias("name"), F.lit("warning").alias("severity"))
    return leaves.unionByName(links).unionByName(single)


def region_matrix(by_metric: DataFrame, by_hops: DataFrame, by_width: DataFrame, regions: DataFrame) -> DataFrame:
    """Between two regions, in either direction: pairs with a path, the least hops, the least metric, and the widest bottleneck."""
    side = lambda c, n: regions.select(F.col("node").alias(c), F.col("region").alias(n))

    def at(df: DataFrame) -> DataFrame:
        rows = df.filter("src <> dst").join(side("src", "x"), "src").join(side("dst", "y"), "dst")
        return rows.groupBy(F.least("x", "y").alias("from_region"), F.greatest("x", "y").alias("to_region"))

    m = at(by_metric).agg(F.count("*").alias("n_paths"), F.min("cost").alias("min_metric"))
    h = at(by_hops).agg(F.min("hops").cast("long").alias("min_hops"))
    b = at(by_width).agg((-F.min("cost")).alias("bottleneck"))
    return m.join(h, ["from_region", "to_region"]).join(b, ["from_region", "to_region"])


def addition_impact(all_pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(scenario, n_improved, saved): pairs that a new edge (scenario, a, b, metric), used both ways, would make cheaper.

    From the table of all distances: d(u, a) + w + d(b, v) against d(u, v); pairs without a path gain but save nothing.
    """
    d = all_pairs.select("src", "dst", F.col("cost").alias("d"))
    ways = candidates.unionByName(candidates.select("scenario", F.col("b").alias("a"), F.col("a").alias("b"), "metric"))
    to = d.select(F.col("src").alias("u"), F.col("dst").alias("a"), F.col("d").alias("d1"))
    out = d.select(F.col("src").alias("b"), F.col("dst").alias("v"), F.col("d").alias("d2"))
    via = ways.join(to, "a").join(out, "b").filter("u <> v").groupBy("scenario", "u", "v").agg(F.min(F.col("d1") + F.col("metric") + F.col("d2")).alias("after"))
    rows = via.join(d.select(F.col("src").alias("u"), F.col("dst").alias("v"), "d"), ["u", "v"], "left")
    better = F.col("d").isNull() | (F.col("after") < F.col("d"))
    return rows.groupBy("scenario").agg(F.count_if(better).alias("n_improved"), F.sum(F.when(F.col("after") < F.col("d"), F.col("d") - F.col("after")).otherwise(0)).alias("saved"))


def redundancy_gains(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(scenario, node): ends of a new edge (scenario, a, b) that have one neighbour now and would have two. Both sides meet by node."""
    near = edges.filter("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("other"))
    near = near.unionByName(near.select(F.col("other").alias("node"), F.col("node").alias("other")))
    leaves = near.groupBy("node").agg(F.min("other").alias("only"), F.max("other").alias("last")).filter(F.col("only") == F.col("last"))
    ends = candidates.select("scenario", F.col("a").alias("node"), F.col("b").alias("to")).unionByName(candidates.select("scenario", F.col("b").alias("node"), F.col("a").alias("to")))
    return ends.join(leaves, "node").filter((F.col("to") != F.col("only")) & (F.col("to") != F.col("node"))).select("scenario", "node").distinct()
