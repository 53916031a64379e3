"""Bridges and cut nodes of an undirected graph: spanning forest, tour of its trees, and labels summed by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable


def links_of(edges: DataFrame) -> DataFrame:
    """(a, z): the pairs of nodes with an edge (src, dst) in either direction, a below z."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("z")).distinct()


def _compressed(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest of parents (node, parent), roots being their own: each round doubles the reach."""
    now = durable(parents)
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        nxt = durable(now.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("node", F.col("parent").alias("root"))
        now = nxt.drop("moved")


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, z) of a forest that spans each component, and the root of each node's component (node, root).

    Every part takes its least link to another part, by hash (Boruvka), so that parts at least halve in number each round.
    """
    parts = durable(links.select(F.explode(F.array("a", "z")).alias("node")).distinct().withColumn("root", F.col("node")))
    open_ = durable(links.select("a", "z", F.col("a").alias("ra"), F.col("z").alias("rz"), F.xxhash64("a", "z").alias("w")))
    forest = None
    while not open_.isEmpty():
        sides = open_.select("ra", "rz", "w", "a", "z").unionByName(open_.select(F.col("rz").alias("ra"), F.col("ra").alias("rz"), "w", "a", "z"))
        chosen = durable(sides.groupBy("ra").agg(F.min(F.struct("w", "a", "z", "rz")).alias("c")))
        taken = chosen.select("c.a", "c.z").distinct()
        forest = taken if forest is None else forest.unionByName(taken)
        # Two parts that chose the same link choose each other: the lesser is the root.
        to = chosen.select(F.col("ra").alias("node"), F.col("c.rz").alias("to"))
        back = to.select(F.col("node").alias("to"), F.col("to").alias("back"))
        parents = to.join(back, "to").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("parent"))
        roots = _compressed(parents)
        one = roots.select(F.col("node").alias("ra"), F.col("root").alias("na"))
        two = roots.select(F.col("node").alias("rz"), F.col("root").alias("nz"))
        parts = durable(parts.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        open_ = durable(open_.join(one, "ra").join(two, "rz").filter("na <> nz").select("a", "z", F.col("na").alias("ra"), F.col("nz").alias("rz"), "w"))
    return durable(forest) if forest is not None else links.select("a", "z"), parts


def _tour(forest: DataFrame) -> DataFrame:
    """(u, v, nu, nv): each arc of the forest's trees and the one that follows it on a tour around its tree; null at one arc of each tree."""
    arcs = forest.select(F.col("a").alias("u"), F.col("z").alias("v")).unionByName(forest.select(F.col("z").alias("u"), F.col("a").alias("v")))
    around = Window.partitionBy("v").orderBy("u")
    first = F.min("u").over(Window.partitionBy("v"))
    return arcs.select("u", "v", F.col("v").alias("nu"), F.coalesce(F.lead("u").over(around), first).alias("nv"))


def _sums_to_the_end(tour: DataFrame, values: list[str]) -> DataFrame:
    """tour (u, v, nu, nv, values) with each value replaced by the exclusive or of all from this arc to its list's end, by pointer doubling."""
    now = durable(tour)
    while not now.filter("nu IS NOT NULL").isEmpty():
        ahead = now.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("mu"), F.col("nv").alias("mv"), *[F.col(c).alias(f"n_{c}") for c in values])
        joined = now.join(ahead, ["nu", "nv"], "left")
        now = durable(joined.select("u", "v", F.col("mu").alias("nu"), F.col("mv").alias("nv"), *[F.col(c).bitwiseXOR(F.coalesce(f"n_{c}", F.lit(0).cast("long"))).alias(c) for c in values]))
    return now


def bridges(edges: DataFrame) -> DataFrame:
    """(a, z): links without which their ends have no way to each other. edges: (src, dst), any nodes that can be ordered.

    Each link outside a spanning forest gets 128 random bits. A link of the forest is a bridge just if the bits of all links that lead
    around it are zero together, but for a chance of 2^-128. These are the bits at the nodes of one of its sides, which a tour of the tree
    has between the link's two directions. Forest and sums take rounds that grow with the logarithm of the nodes; no search is made for a link.
    Pairs with several edges count as one link.
    """
    links = durable(links_of(edges))
    forest, parts = spanning_forest(links)
    loose = links.join(forest, ["a", "z"], "left_anti").withColumns({k: F.xxhash64(F.lit(k), "a", "z") for k in ("x", "y")})
    ends = loose.select(F.col("a").alias("v"), "x", "y").unionByName(loose.select(F.col("z").alias("v"), "x", "y"))
    at = ends.groupBy("v").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    tour = _tour(forest)
    # A node's bits count at one arc into it, that from its least neighbour; at the root, the tour is cut behind that arc.
    own = F.col("u") == F.min("u").over(Window.partitionBy("v"))
    tops = parts.filter("node = root").select(F.col("root").alias("v"), F.lit(True).alias("top"))
    tour = tour.withColumn("own", own).join(at, "v", "left").join(tops, "v", "left").withColumn("last", F.when(F.col("own") & F.col("top"), True))
    bits = {k: F.when(F.col("own"), F.coalesce(k, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")) for k in ("x", "y")}
    nxt = {k: F.when(F.col("last").isNull(), F.col(k)) for k in ("nu", "nv")}
    sums = _sums_to_the_end(tour.withColumns(bits | nxt).select("u", "v", "nu", "nv", "x", "y"), ["x", "y"])
    pairs = sums.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("z")).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return pairs.filter("x = 0 AND y = 0").select("a", "z")
