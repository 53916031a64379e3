"""Near-duplicates by SimHash: fingerprints meet in grids of segment bit counts and are verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, salt, salt_count, text_batches
from .components import components

EVEN = 0x5555555555555555
#: Shingles whose bits are counted together.
CHUNK = 1 << 18
#: Members of a grid cell that are compared pair by pair; more are dealt into the cells of finer grids.
CELL = 4096
#: Bands of the finer grids: a pair within 4 bits shares a cell of one over 8 of 12 bands, which hold 21 of the 32 segments.
FINE = 12


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # on bytes: ASCII only
    if len(words) < width:
        return [digest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """For each list: the bits that are set in over half of its hashes; 0 for none.

    Eight bits are counted at a time, in the eight bytes of a word, over blocks of at most 255 hashes.
    """
    n = np.array([len(h) for h in hashes], np.int64)
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
    out = np.zeros(len(n), np.uint64)
    own = np.flatnonzero(n)
    if not len(own):
        return out
    n = n[own]
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    begin = np.repeat(np.cumsum(n) - n, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * 255
    bits = np.zeros((len(n), 8, 8), np.uint8)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & np.uint64(0x0101010101010101), begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits[:, :, k] = 2 * counts > n[:, None]
    out[own] = np.packbits(bits.reshape(len(n), 64), axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[str | None], width: int = 4, seed: int = 42) -> np.ndarray:
    done, waiting, held = [], [], 0
    for text in texts:
        waiting.append(shingle_hashes(text, width, seed))
        held += len(waiting[-1])
        if held >= CHUNK:
            done.append(majority(waiting))
            waiting, held = [], 0
    done.append(majority(waiting))
    return np.concatenate(done).view(np.int64)


def fingerprint(text: str, width: int = 4, seed: int = 42) -> Column:
    """The 64-bit fingerprint of column text, as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints_of(texts.tolist(), width, seed))

    return of(F.col(text))


def bit_counts(fp: Column) -> Column:
    """The embedding: the bit count of each of 32 two-bit segments, in unary.

    00, 01 and 11 stand for 0, 1 and 2, so the Manhattan distance of two embeddings is the number of differing
    bits; it never exceeds the Hamming distance of the fingerprints.
    """
    a, b = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grids(bands: int, most: int) -> list[int]:
    """Masks of the grids. Segments are cut into bands; if the counts of two fingerprints differ by `most` in all, at
    least bands - most bands agree, so the pair shares a cell of the grid over those bands."""
    edges = np.linspace(0, 32, bands + 1).round().astype(int)
    band = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(c) for c in combinations(band, bands - most)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def unary(fp: np.ndarray) -> np.ndarray:
    a, b = fp & np.uint64(EVEN), (fp >> np.uint64(1)) & np.uint64(EVEN)
    return (a | b) | ((a & b) << np.uint64(1))


def close(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, most: int) -> np.ndarray:
    """First the lower bound, then the exact distance of those it leaves."""
    near = np.bitwise_count(ux ^ uy) <= most
    near[near] = np.bitwise_count((x ^ y)[near]) <= most
    return near


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the links among fp: at most len(fp) - 1 of them."""
    n, u = len(fp), unary(fp)
    left, right = [], []
    unseen = np.ones(n, bool)
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root] = False
        front = [root]
        while front:
            i = front.pop()
            rest = np.flatnonzero(unseen)
            if not len(rest):
                return np.array(left, np.int64), np.array(right, np.int64)
            found = rest[close(fp[rest], fp[i], u[rest], u[i], most)]
            unseen[found] = False
            left += [i] * len(found)
            right += found.tolist()
            front += found.tolist()
    return np.array(left, np.int64), np.array(right, np.int64)


def links_in_cells(cell: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links among rows sorted by cell: all pairs of small cells, spanning forests of larger ones."""
    edge = np.flatnonzero(np.diff(cell)) + 1
    start = np.concatenate([[0], edge])
    size = np.diff(np.concatenate([start, [len(cell)]]))
    u = unary(fp)
    left, right = [], []
    many = size > 8
    for s, n in zip(start[many], size[many], strict=True):
        a, b = forest(fp[s : s + n], most)
        left.append(a + s)
        right.append(b + s)
    few = np.repeat(~many, size)
    for d in range(1, 8):
        i = np.flatnonzero((cell[d:] == cell[:-d]) & few[d:])
        if not len(i):
            break
        i = i[close(fp[i], fp[i + d], u[i], u[i + d], most)]
        left.append(i)
        right.append(i + d)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def cell_links(most: int, cell_cap: int):
    """A function over the rows (cell, fp, rep) of a partition sorted by cell: gives links (a, b) between reps. A cell of
    more than cell_cap rows gives its members as (a, null), as they stream by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        big = None  # the cell that is streaming by

        def settle(cell: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
            a, b = links_in_cells(cell, fp.view(np.uint64), most)
            return pd.DataFrame({"a": rep[a], "b": pd.array(rep[b], "Int64"), "fp": fp[a]})

        def alone(fp: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": rep, "b": pd.array([pd.NA] * len(rep), "Int64"), "fp": fp})

        for batch in batches:
            cols = [np.concatenate([h, batch[c].to_numpy(np.int64)]) for h, c in zip(held, ("cell", "fp", "rep"), strict=True)]
            if big is not None:
                more = int(np.searchsorted(cols[0] != big, True))
                yield alone(cols[1][:more], cols[2][:more])
                cols = [c[more:] for c in cols]
                if not len(cols[0]):
                    held = cols
                    continue
                big = None
            start = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1])
            size = np.diff(np.concatenate([start, [len(cols[0])]]))
            over = np.repeat(size > cell_cap, size)
            last = start[-1]
            if over.any():
                yield alone(cols[1][over], cols[2][over])
            if over[-1]:
                big = cols[0][-1]
            ready = ~over
            ready[last:] = False
            yield settle(*[c[ready] for c in cols])
            held = [c[last:] if big is None else c[:0] for c in cols]
        if len(held[0]):
            yield settle(*held)

    return run


def flips(fp: Column, most: int) -> Column:
    """All fingerprints within most // 2 bits of fp, most being at most 4: 2,081 for 4."""
    masks = [sum(1 << i for i in c) for k in range(most // 2 + 1) for c in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: m.bitwiseXOR(fp))


def near_duplicates(docs: DataFrame, *, most: int = 4, width: int = 4, seed: int = 42, bands: int = 7, cell_cap: int = CELL) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    Fingerprints (signed longs) link at `most` or fewer differing bits (an even number); component_id is the least doc_id
    reachable. Equal fingerprints are one node from the start. Nodes are dealt into the cells of several grids over
    segment bit counts, in which every close pair meets, and verified there. Members of crowded cells (over cell_cap) are dealt
    again, by finer grids, and what is still crowded then meets by its bit flips.

    Very long texts are read whole, other columns ignored. Null, empty and blank texts have fingerprint 0 and link like others. Rows without
    doc_id link like others too, but name no component: one in which no row has a doc_id is null. Repeated rows are returned as
    often as they come, and an empty table gives no rows.
    """
    if most % 2 or not 0 < most < bands:
        raise ValueError("most must be even and less than bands")
    text_batches(docs.sparkSession)
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text", width, seed).alias("fp")))
    parts_n = salt_count(rows.count())
    # Rows, not ids, are dealt: ids may all be null or equal.
    rows = durable(rows.withColumn("part", salt(F.monotonically_increasing_id(), parts_n)))
    # One row per fingerprint and part, so that neither copies nor their join meet in one task.
    parts = durable(rows.groupBy("fp", "part").agg(F.min("doc_id").alias("least")))
    reps = durable(parts.groupBy("fp").agg(F.min("least").alias("least")))
    edges, crowded = None, reps.select("fp", F.col("fp").alias("rep"))
    for n in (bands, FINE):
        masks = F.array(*map(F.lit, grids(n, most)))
        cells = crowded.select(F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(bit_counts(F.col("fp"))))).alias("grid", "counts"), "fp", "rep")
        dealt = cells.select(F.xxhash64("grid", "counts").alias("cell"), "fp", "rep").repartition("cell").sortWithinPartitions("cell")
        found = durable(dealt.mapInPandas(cell_links(most, cell_cap), "a long, b long, fp long").distinct())
        links = found.filter("b IS NOT NULL").select("a", "b")
        edges = links if edges is None else edges.unionByName(links)
        crowded = found.filter("b IS NULL").select("fp", F.col("a").alias("rep")).distinct()
        if crowded.isEmpty():
            break
    else:
        # Fingerprints of which thousands have the same counts in 21 segments: two within 4 bits have a common neighbour within 2 of either.
        flipped = crowded.select(F.col("rep").alias("a"), F.explode(flips(F.col("fp"), most)).alias("flip"))
        stars = flipped.groupBy("flip").agg(F.min("a").alias("m"), F.count("*").alias("n")).filter("n > 1").select("flip", "m")
        edges = edges.unionByName(flipped.join(stars.hint("merge"), "flip").filter("a <> m").select("a", F.col("m").alias("b")).distinct())
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = durable(reps.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    labels = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(labels.hint("merge"), "root").select("fp", "component_id")
    whole = parts.select("fp", "part").join(named.hint("merge"), "fp")
    return rows.join(whole.hint("merge"), ["fp", "part"]).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
