"""Sharding by balanced label propagation: linked documents move together while shards stay even."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_bits, durable, prefix_sums, running, salt, salt_count

#: Bits of a hash that orders movers of the same size class.
HASH_BITS = 20


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard: at most one apart."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def bounds(sizes: list[int]) -> list[int]:
    return [0, *accumulate(sizes)]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _place(rank: Column, upto: list[int]) -> Column:
    """The interval of upto that holds rank."""
    return (F.size(F.filter(_array(upto[1:]), lambda b: b <= rank))).cast("int")


def _cut_into(rows: DataFrame, cuts: list[int], seed: str, by: tuple[str, ...] = ("key", "part")) -> DataFrame:
    """(key, shard, n) of rows (key, part, n): ranked in the order of a hash of `by`, in the intervals between the cuts."""
    bits = bucket_bits(rows.count())
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by), 4))
    ranked = prefix_sums(hashed.withColumn("bucket", F.shiftright("h", 60 - bits)), [], "bucket", ["h", "key", "part"], "n")
    pieces = [F.struct(F.lit(i).alias("shard"), F.lit(a).cast("long").alias("lo"), F.lit(b).cast("long").alias("hi")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    inside = F.least("s.hi", F.col("before") + F.col("n")) - F.greatest("s.lo", "before")
    spread = ranked.withColumn("s", F.explode(F.array(*pieces))).select("key", "s.shard", inside.alias("n")).filter("n > 0")
    return spread.groupBy("key", "shard").agg(F.sum("n").alias("n"))


def first_cells(linked: DataFrame, quota: list[int], rows: int) -> DataFrame:
    """(key, shard, n): linked rows in hash order, cut in proportion to the quotas, so that none is passed."""
    total = linked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _cut_into(linked, [c * total // max(rows, 1) for c in bounds(quota)], "first")


def move(cells: DataFrame, room: list[int], bits: int) -> DataFrame:
    """(key, shard, target, accepted): one round of moves.

    Each cell wants the shard, among those with room, that holds most of its group; ties go by a hash of group and
    shard, so that no shard is favoured. Large cells are admitted first, by prefix sums, until the room is full.
    """
    has_room = F.element_at(_array(room), F.col("shard") + 1) > 0
    weight = F.struct("n", F.xxhash64("key", "shard").alias("h"), "shard")
    best = F.max(F.when(has_room, weight)).over(Window.partitionBy("key"))
    wants = cells.withColumn("best", best).filter(weight < F.col("best")).select("key", "shard", "n", F.col("best.shard").alias("target"))
    order = (64 - F.length(F.bin("n"))) * (1 << HASH_BITS) + F.pmod(F.xxhash64(F.lit("move"), "key", "shard"), F.lit(1 << HASH_BITS))
    wants = wants.withColumn("order", order).withColumn("bucket", F.shiftright("order", HASH_BITS - bits))
    placed = prefix_sums(wants, ["target"], "bucket", ["order", "key", "shard"], "n")
    left = F.greatest(F.element_at(_array(room), F.col("target") + 1) - F.col("before"), F.lit(0).cast("long"))
    return placed.select("key", "shard", "target", F.least("n", left).alias("accepted")).filter("accepted > 0")


def _loads(cells: DataFrame, shards: int) -> list[int]:
    """Rows in each shard; one number per shard comes to the driver."""
    found = dict(cells.groupBy("shard").agg(F.sum("n")).collect())
    return [found.get(i, 0) for i in range(shards)]


def propagate(cells: DataFrame, quota: list[int], rounds: int, bits: int) -> DataFrame:
    """Cells after up to `rounds` rounds of moves, fewer if nothing moves any more."""
    for _ in range(rounds):
        room = [q - n for q, n in zip(quota, _loads(cells, len(quota)), strict=True)]
        moves = durable(move(cells, room, bits))
        if moves.isEmpty():
            break
        gone = moves.select("key", "shard", (-F.col("accepted")).alias("n"))
        come = moves.select("key", F.col("target").alias("shard"), F.col("accepted").alias("n"))
        cells = durable(cells.unionByName(gone).unionByName(come).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0"))
    return cells


def settle(cells: DataFrame, quota: list[int], bits: int) -> DataFrame:
    """Cells within the exact quotas: each shard keeps its largest cells; those that don't fit go to shards with room.

    Cells stay whole, apart from one that fills a shard alone and those on the bounds of the room they are put into.
    """
    order = (64 - F.length(F.bin("n"))) * (1 << HASH_BITS) + F.pmod(F.xxhash64(F.lit("settle"), "key", "shard"), F.lit(1 << HASH_BITS))
    rows = cells.withColumn("order", order).withColumn("bucket", F.shiftright("order", HASH_BITS - bits))
    placed = prefix_sums(rows, ["shard"], "bucket", ["order", "key"], "n")
    most = F.element_at(_array(quota), F.col("shard") + 1)
    kept = F.when(F.col("before") + F.col("n") <= most, F.col("n")).when(F.col("before") == 0, most).otherwise(F.lit(0).cast("long"))
    placed = durable(placed.select("key", "shard", "n", kept.alias("kept")))
    stay = placed.filter("kept > 0").select("key", "shard", F.col("kept").alias("n"))
    pool = placed.filter("n > kept").select("key", F.col("shard").alias("part"), (F.col("n") - F.col("kept")).alias("n"))
    if pool.isEmpty():
        return stay
    room = bounds([q - n for q, n in zip(quota, _loads(stay, len(quota)), strict=True)])
    moved = _cut_into(pool, room, "pool", ("key",))  # what is left of a group stays together
    return durable(stay.unionByName(moved).groupBy("key", "shard").agg(F.sum("n").alias("n")))


def shard(docs: DataFrame, *, link: Column | None = None, shards: int = 8, rounds: int = 8) -> DataFrame:
    """docs (doc_id, text) dealt over shards whose row counts are at most one apart, keeping linked rows together.

    Rows with equal `link` (by default equal texts) are neighbours. Rows of a group are interchangeable, so
    labels are kept per group and shard, with counts: a group that holds a third of all rows is a few cells,
    and no task or round sees its rows one by one. Rounds of joins move cells towards the shard that holds most
    of their group, under each shard's quota with a quarter to spare; what is over the exact quotas then moves on
    in whole cells, and rows without neighbours fill the rest. A group is cut only where it doesn't fit.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, key (of the group), shard, slot (gapless from 0 in each
    shard). A null text has size 1 and CRC 0 and is linked to other null texts only, an empty one to other empty ones; very long
    texts count as one row; null doc_ids and repeated rows are rows like any other; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    own = link if link is not None else F.col("text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = durable(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(own, own.isNull()).alias("key"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    n = rows.count()
    quota = quotas(n, shards)
    # By row, not by doc_id: equal texts without an id, or with the same, are many rows too.
    rows = rows.withColumn("part", salt("nth", salt_count(n)))
    group = Window.partitionBy("key")
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    parts = durable(parts.withColumn("total", F.sum("n").over(group)).withColumn("offset", running("n", ["key"], ["part"])))
    linked, single = parts.filter("total > 1"), parts.filter("total = 1")
    bits = min(bucket_bits(n), HASH_BITS)
    # Where nearly all rows are linked there is no room to move into, so quotas are wider until the end.
    wide = [q + q // 4 + 1 for q in quota]
    cells = settle(propagate(durable(first_cells(linked, quota, n)), wide, rounds, bits), quota, bits)

    # Ranks within a group are cut at the shards' counts, part by part.
    spans = cells.withColumn("from", running("n", ["key"], ["shard"])).select("key", "shard", "from", (F.col("from") + F.col("n")).alias("to"))
    lo, hi = F.greatest("from", "offset") - F.col("offset"), F.least(F.col("to"), F.col("offset") + F.col("n")) - F.col("offset")
    held = linked.join(spans, "key").select("key", "part", "shard", lo.alias("lo"), hi.alias("hi")).filter("lo < hi")
    free = bounds([q - x for q, x in zip(quota, _loads(cells, shards), strict=True)])
    lone = single.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("fill"), "key"), 4)).withColumn("bucket", F.shiftright("h", 60 - bits))
    lone = prefix_sums(lone, [], "bucket", ["h", "key", "part"], "n")
    lone = lone.select("key", "part", _place(F.col("before"), free).alias("shard"), F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"))
    ranges = held.unionByName(lone)

    rank = F.row_number().over(Window.partitionBy("key", "part").orderBy("doc_id", "size", "text_crc32", "nth")) - 1
    placed = rows.withColumn("rank", rank).join(ranges, ["key", "part"]).filter("rank >= lo AND rank < hi")
    placed = durable(placed.select("doc_id", "size", "text_crc32", "key", "shard", "nth", F.lit(1).cast("long").alias("one")))
    slots = placed.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit("slot"), "nth"), 4)).withColumn("bucket", F.shiftright("h", 60 - bits))
    slots = prefix_sums(slots, ["shard"], "bucket", ["h", "nth"], "one", out="slot")
    return slots.select("doc_id", "size", "text_crc32", "key", "shard", "slot")
