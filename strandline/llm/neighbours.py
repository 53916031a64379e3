"""Nearest neighbours by collision counting over sorted projections, with query-centred windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, salt, stored

#: Projections that order the vectors, and the numbers that a block of vectors may hold.
LEADS, BLOCK_NUMBERS = 8, 1 << 17
#: A window is wider than its radius by this much, for rounding.
SLACK = 1e-9


@lru_cache(16)
def axes(dim: int, lines: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, lines))


def least_hits(lines: int, spare: float) -> int:
    """Windows of `lines` that must hold a vector. A window reaches as far as the radius R; a vector at distance R lies in each
    with probability 0.683, and more often if nearer. The threshold is `spare` standard deviations below what R gives."""
    p = math.erf(1 / math.sqrt(2))
    return math.floor(lines * p - spare * math.sqrt(lines * p * (1 - p)))


def order_key(leads: np.ndarray) -> list[bytes]:
    """Rows in the order of these keys lie near each other on all leading lines: their bits are interleaved, the highest first."""
    bits = (leads.astype(np.float32) + np.float32(0)).view(np.uint32)
    bits = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(1 << 31))  # in the order of the numbers
    planes = np.unpackbits(bits.astype(">u4").view(np.uint8).reshape(len(bits), LEADS, 4), axis=2)
    return [x.tobytes() for x in np.packbits(planes.transpose(0, 2, 1).reshape(len(bits), -1), axis=1)]


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, also where squares would leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        apart = vectors - query
        out = np.sqrt((apart**2).sum(axis=1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < 1e140)))
        if len(odd):
            far = np.abs(apart[odd])
            most = far.max(axis=1)
            unit = np.where((most > 0) & np.isfinite(most), most, 1)[:, None]
            out[odd] = np.where(np.isfinite(most), most * np.sqrt(((far / unit) ** 2).sum(axis=1)), np.inf)
    return out


def unit_of(vectors: np.ndarray, unit: float) -> float:
    """The unit of a block: its own greatest component, so that no far vector elsewhere widens its windows. A power of two, or the table's
    unit where the block has none."""
    most = float(np.abs(vectors).max()) if vectors.size else 0.0
    return 2.0 ** math.floor(math.log2(most)) if most > 0 else unit


class Index:
    """One block of vectors with its projections, each sorted; a window on a line is a range of ranks."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, unit: float, *, lines: int, spare: float, seed: int):
        self.v, self.ids, self.least = vectors, ids, least_hits(lines, spare)
        self.unit = unit = unit_of(vectors, unit)
        self.axes = axes(vectors.shape[1], lines, seed)
        p = (vectors / unit) @ self.axes
        order = np.argsort(p, axis=0, kind="stable")
        self.sorted = np.take_along_axis(p, order, axis=0).T.copy()
        self.rank = np.empty((lines, len(ids)), np.uint16)
        np.put_along_axis(self.rank, order.T, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
        # All lines as one sorted array: each line's own range follows the one before.
        self.low, self.span = float(self.sorted.min()), float(self.sorted.max() - self.sorted.min()) + 1
        self.base = np.arange(lines) * (2 * self.span)
        self.flat = (self.sorted - self.low + self.base[:, None]).ravel()
        self.begin = np.arange(lines) * len(ids)
        n = len(ids)
        self.first = max(float(np.median(self.sorted[:, 3 * n // 4] - self.sorted[:, n // 4])) / 8, 1e-12)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        edge = lambda x, side: np.searchsorted(self.flat, np.clip(x - self.low, -0.5, self.span - 0.5) + self.base, side) - self.begin
        return edge(at - half, "left"), edge(at + half, "right")

    def search(self, query: np.ndarray, own: int, k: int, radius: float, widen: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances, number verified) of the k nearest found within radius, ties to the smaller id.

        Where the radius is not known, windows widen (virtual rehashing) until they reach as far as the k-th nearest found. A vector that
        lies in `least` windows or more is verified by its exact distance.
        """
        at = (query / self.unit) @ self.axes
        n = len(self.ids)
        seen, found = np.zeros(n, bool), np.full(n, np.inf)
        other = self.ids != own
        half = radius / self.unit if np.isfinite(radius) else self.first
        while True:
            a, b = self.windows(at, half * (1 + SLACK) + SLACK * self.span)
            inside = self.rank - a.astype(np.uint16)[:, None] < (b - a).astype(np.uint16)[:, None]  # below a is far above b, without sign
            hits = inside.view(np.uint8).sum(axis=0, dtype=np.uint8)
            fresh = np.flatnonzero((hits >= self.least) & ~seen)
            seen[fresh] = True
            found[fresh] = distances(self.v[fresh], query)
            known = np.sort(found[seen & other])
            reach = min(radius, known[k - 1] if len(known) >= k else np.inf) / self.unit
            if half >= reach or (b - a == n).all():
                break
            half = min(half * widen, max(reach, half * 1.01)) if np.isfinite(reach) else half * widen
        some = np.flatnonzero(seen & other & (found <= radius))
        best = some[np.lexsort((self.ids[some], found[some]))[:k]]
        return self.ids[best], found[best], int(seen.sum())


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows (vec_id, v): doubles, without vectors that are null, zero, or hold null or non-finite components."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that can't be among any query's k: of equal vectors, those with the k + 1 smallest ids go before all
    others, and of equal rows k do. So a vector that a third of all rows share is a few rows."""
    distinct = rows.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    first = Window.partitionBy("v").orderBy("vec_id")
    few = distinct.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    return few.select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("vec_id", "v")


def _keyed(unit: float, lines: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.assign(key=None)
            for dim, rows in batch.groupby("dim"):
                at = (np.stack(rows["v"].to_numpy()) / unit) @ axes(dim, lines, seed)[:, :LEADS]
                out.loc[rows.index, "key"] = pd.Series(order_key(at), index=rows.index, dtype=object)
            out["v"] = [np.asarray(v, "<f8").tobytes() for v in batch["v"]]
            yield out[["vec_id", "asked", "dim", "key", "v"]]

    return run


BLOCK = "block long, dim int, ids binary, v binary, asked binary, asked_v binary, low binary, high binary"


def _blocks(unit: float, lines: int, seed: int, block_rows: int):
    """Blocks of consecutive rows (vec_id, asked, dim, v): vectors, the queries among them, and their bounds on each line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            nonlocal number
            number += 1
            dim = held[0][2]
            mine, asked = [r for r in held if not r[1]], [r for r in held if r[1]]
            at = (np.frombuffer(b"".join(r[3] for r in mine), "<f8").reshape(-1, dim) / unit) @ axes(dim, lines, seed)
            low, high = (at.min(axis=0), at.max(axis=0)) if len(mine) else (np.full(lines, np.inf), np.full(lines, -np.inf))
            pack = lambda rows: (np.array([r[0] for r in rows], "<i8").tobytes(), b"".join(r[3] for r in rows))
            row = (number, dim, *pack(mine), *pack(asked), low.astype("<f8").tobytes(), high.astype("<f8").tobytes())
            held.clear()
            return pd.DataFrame([row], columns=["block", "dim", "ids", "v", "asked", "asked_v", "low", "high"])

        for batch in batches:
            for row in zip(batch["vec_id"], batch["asked"], batch["dim"], batch["v"], strict=True):
                if held and (row[2] != held[0][2] or len(held) >= max(16, min(block_rows, BLOCK_NUMBERS // row[2]))):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return run


FOUND = "query_id long, vec_id long, score double, verified long"


def _answer(index: Index, query_id: int, q: np.ndarray, k: int, radius: float, widen: float) -> pd.DataFrame:
    ids, far, verified = index.search(q, query_id, k, radius, widen)
    # A row without vec_id tells how many were verified.
    return pd.DataFrame({"query_id": query_id, "vec_id": pd.array([*ids, None], "Int64"), "score": [*far, np.nan], "verified": [0] * len(ids) + [verified]})


def _index(row, unit: float, settings: dict) -> Index:
    ids = np.frombuffer(row.ids, "<i8")
    return Index(np.frombuffer(row.v, "<f8").reshape(len(ids), row.dim), ids, unit, **settings)


def _home(unit: float, k: int, widen: float, settings: dict):
    """Answers to the queries of each block from the block alone; the k-th distance bounds what other blocks need look for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                asked = np.frombuffer(row.asked, "<i8")
                if not len(asked):
                    continue
                index = _index(row, unit, settings) if len(row.ids) else None
                for q, v in zip(asked.tolist(), np.frombuffer(row.asked_v, "<f8").reshape(len(asked), row.dim), strict=True):
                    got = _answer(index, q, v, k, np.inf, widen) if index else pd.DataFrame({"query_id": [q], "vec_id": pd.array([None], "Int64"), "score": [np.nan], "verified": [0]})
                    far = got["score"].to_numpy()[:-1]
                    got["radius"] = far[k - 1] if len(far) >= k else np.inf
                    yield got.assign(block=row.block, dim=row.dim, v=v.astype("<f8").tobytes())

    return run


PACK = "block long, dim int, asked binary, asked_v binary, radius binary"


def _meet(unit: float, settings: dict, pack: int):
    """Which blocks each query has to look into: those in which enough windows of its radius overlap the block's range."""

    def run(key: tuple, queries: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
        out, dim = [], int(key[0])
        least = least_hits(settings["lines"], settings["spare"])
        v = np.frombuffer(b"".join(queries["v"]), "<f8").reshape(-1, dim)
        at, ids, home = (v / unit) @ axes(dim, settings["lines"], settings["seed"]), queries["query_id"].to_numpy(np.int64), queries["block"].to_numpy(np.int64)
        radius = queries["radius"].to_numpy(float)
        half = np.minimum(radius / unit, 1e300) * (1 + SLACK)
        span = np.abs(at).max() if len(at) else 0
        for row in bounds.itertuples(index=False):
            low, high = np.frombuffer(row.low, "<f8"), np.frombuffer(row.high, "<f8")
            wide = (half + SLACK * (1 + span + np.abs(low).max() + np.abs(high).max()))[:, None]
            hits = ((at + wide >= low) & (at - wide <= high)).sum(axis=1)
            some = np.flatnonzero((hits >= least) & (home != row.block))
            for x in range(0, len(some), pack):
                s = some[x : x + pack]
                out.append((row.block, dim, ids[s].tobytes(), v[s].tobytes(), radius[s].tobytes()))
        return pd.DataFrame(out, columns=["block", "dim", "asked", "asked_v", "radius"])

    return run


def _visit(unit: float, k: int, widen: float, settings: dict):
    """Answers of a block to packs of queries from elsewhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, index = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block != last:
                    last, index = row.block, _index(row, unit, settings)
                asked = np.frombuffer(row.asked, "<i8")
                v, radius = np.frombuffer(row.asked_v, "<f8").reshape(len(asked), row.dim), np.frombuffer(row.radius, "<f8")
                yield pd.concat([_answer(index, q, x, k, r, widen) for q, x, r in zip(asked.tolist(), v, radius.tolist(), strict=True)])

    return run


def answers(
    vectors: DataFrame,
    *,
    k: int = 10,
    every: int = 100,
    vector: str = "embedding",
    lines: int = 240,
    spare: float = 0.8,
    widen: float = 1.25,
    seed: int = 8,
    block_rows: int = 2048,
    together: int = 1024,
) -> DataFrame:
    """(query_id, vec_id, score, verified) from all blocks, before the best k are chosen; rows without vec_id have the number of
    vectors that a block verified for the query."""
    if not (0 < lines < 256 and 0 < block_rows < 1 << 16):  # hits are counted in bytes, ranks in two
        raise ValueError("lines must be below 256, and block_rows below 65,536")
    rows = durable(usable(vectors, vector))
    most = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    unit = 2.0 ** math.floor(math.log2(most)) if most else 1.0
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    both = candidates(rows, k).withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    keyed = durable(both.withColumn("dim", F.size("v")).mapInPandas(_keyed(unit, lines, seed), "vec_id long, asked boolean, dim int, key binary, v binary"))
    parts = max(2, math.ceil(keyed.count() / (8 * block_rows)))
    sorted_rows = keyed.repartitionByRange(parts, "dim", "key", "vec_id").sortWithinPartitions("dim", "key", "vec_id")
    blocks = stored(sorted_rows.select("vec_id", "asked", "dim", "v").mapInPandas(_blocks(unit, lines, seed, block_rows), BLOCK), "blocks")

    settings = {"lines": lines, "spare": spare, "seed": seed}
    home = durable(blocks.mapInPandas(_home(unit, k, widen, settings), f"{FOUND}, radius double, block long, dim int, v binary"))
    queries = home.filter("vec_id IS NULL").select("query_id", "radius", "block", "dim", "v")
    bounds = blocks.filter(F.length("ids") > 0).select("block", "dim", "low", "high")
    # Groups of queries meet groups of blocks by their bounds alone, a few hundred bytes a vector in a thousand.
    query_groups, block_groups = (max(1, math.ceil(df.count() / together)) for df in (queries, bounds))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qg", salt("query_id", query_groups)).withColumn("bg", number(block_groups))
    right = bounds.withColumn("bg", salt("block", block_groups)).withColumn("qg", number(query_groups))
    packs = left.groupBy("dim", "qg", "bg").cogroup(right.groupBy("dim", "qg", "bg")).applyInPandas(_meet(unit, settings, 256), PACK)
    visits = packs.join(blocks.select("block", "ids", "v").hint("merge"), "block")
    away = visits.mapInPandas(_visit(unit, k, widen, settings), FOUND)
    return home.select("query_id", "vec_id", "score", "verified").unionByName(away)


def nearest(vectors: DataFrame, *, k: int = 10, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by Euclidean distance, for each row whose vec_id is divisible by `every`.

    All vectors are projected on `lines` random lines and range-sorted over the whole table by an interleaving of the first
    eight projections; blocks of up to block_rows consecutive vectors keep their projections as sorted arrays, with their range on
    each line. A query first searches its own block: windows around its projections widen until they reach as far as its k-th
    nearest there. That distance is the radius of its windows everywhere else. A block is visited only if enough of them
    overlap its ranges (no vector in it could reach the threshold otherwise), and in it only vectors in enough windows are
    verified (least_hits). Where data have structure few blocks are visited; where they have none, all are, and the threshold
    alone saves work.

    Unusable vectors (see usable()) and rows without vec_id take no part. Rows that repeat a query's id are one query, that
    with the least vector, and never candidates for it; rows that repeat another vector's id are candidates each. Ties go to the
    smaller vec_id; distances that leave the range of doubles are infinite and come last. Vectors meet only those of their own length;
    long ones make smaller blocks. Other columns are ignored. A query with fewer than k candidates gets all, and an empty table gives no rows.
    """
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = answers(vectors, k=k, **settings).filter("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
