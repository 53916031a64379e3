"""Connected components by alternating stars, as Spark joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, salt

#: Neighbours of one node that meet its least one in one task, and the parts of nodes with more neighbours than that.
TOGETHER, LEAST = 250_000, 16


def _star(near: DataFrame) -> DataFrame:
    """(v, least of u's star) for each neighbour v of u in near; near: (u, v).

    The least neighbour is a map-side aggregate. It meets the neighbours by node and salt, so that a node with
    very many neighbours is spread over as many tasks as its neighbours call for.
    """
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    most = near.groupBy("u").count().agg(F.max("count")).first()[0] or 0
    parts = max(LEAST, math.ceil(most / TOGETHER)) if most > LEAST else 1
    if parts <= 1:
        return near.join(least.hint("merge"), "u").select("u", "v", "m")
    least = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return near.withColumn("s", salt("v", parts)).join(least.hint("merge"), ["u", "s"]).select("u", "v", "m")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of the edges (a, b) of one partition, by union and find."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            x, y = sorted((root(a), root(b)))
            above[y] = x
    yield pd.DataFrame({"node": list(above), "root": [root(x) for x in list(above)]}, dtype="int64")


def components(edges: DataFrame, max_rounds: int = 40, *, few: int = 0) -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge. edges: (a, b), integers, any order.

    few: up to so many edges meet in one task, which takes less than the many small tasks of a round; they are counted first, so
    what they are made of should be kept already. More go through rounds.

    Rounds of large stars and small stars (Kiveris et al. 2014), whose number grows with the logarithm of the
    longest path; each round's edges are kept in the shared folder. Loops, repeated and null edges change nothing.
    """
    if few and edges.count() <= few:
        return durable(edges.filter("a <> b").select("a", "b").coalesce(1).mapInPandas(_joined, "node long, root long"))
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = durable(e)
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        star = _star(large)
        small = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(star.select("u", F.col("m").alias("v"))).distinct()
        e = durable(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
