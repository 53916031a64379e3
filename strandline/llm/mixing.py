"""Mixing sources to target weights: random order within each source, prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_bits, durable, hash60, prefix_sums, salt


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most_epochs: int) -> DataFrame:
    """Words wanted from each source.

    sizes: (source, source_size), one row per source; the number of sources bounds the one task that
    ranks them. Sources in code point order, null last, get the weights in turn. They share
    `share` times all words by weight; no target passes most_epochs times its source, and the excess
    goes to the others by weight until none is above. That fixed point is found in one pass: ordered by
    cap over weight, capped sources form a prefix, and the first source below its cap sets the common rate.
    """
    everything = Window.partitionBy()
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    ratio = Window.orderBy("ratio", "rank")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.array(*map(F.lit, weights))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_code))
        .withColumn("weight", F.element_at(turn, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most_epochs)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("place", F.row_number().over(ratio))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("own", (F.col("budget") - F.col("capped_before")) * F.col("weight") / F.col("weight_left"))
    )
    free = F.when(F.col("cap") > F.col("own"), F.struct("place", "capped_before", "weight_left"))
    return (
        ranked.withColumn("first_free", F.min(free).over(everything))
        .withColumn(
            "target",
            F.when(F.col("first_free").isNull() | (F.col("place") < F.col("first_free.place")), F.col("cap").cast("double")).otherwise(
                (F.col("budget") - F.col("first_free.capped_before")) * F.col("weight") / F.col("first_free.weight_left")
            ),
        )
        .select("source", "weight", "source_size", "target")
    )


def copy_key(seed: str, copy: Column, digest: Column) -> Column:
    """A row's key in the order of its source: by id and text, and for equal rows by which of them it is."""
    return hash60(seed, F.col("doc_id"), digest, copy)


def own_columns(seed: str, size: Column | None) -> dict[str, Column]:
    """What the mix needs of a row: its size, its place in its source's order, and a source key that is never null."""
    words = size if size is not None else F.regexp_count("text", F.lit(WORD))
    return {
        "size": F.coalesce(words, F.lit(0)).cast("long"),
        "digest": F.coalesce(F.md5("text"), F.lit("~")),
        "key": copy_key(seed, F.lit(0), F.coalesce(F.md5("text"), F.lit("~"))),
        "source_key": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")),
    }


ORDER = ["key", "doc_id", "size", "digest"]


def ordered(
    docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, seed: str = "mix", size: Column | None = None, apart: bool = True
) -> DataFrame:
    """Rows of docs in the random order of their sources: `before` (words of the source that come earlier), `epochs` (whole
    passes over the source) and `left` (words that the last, partial pass takes).

    Equal rows are counted first. If apart, each then gets a key of its own, so that they lie anywhere in the order; else one row
    stands for all of them. So neither null ids nor repeated rows make a key that many rows share.
    """
    own = own_columns(seed, size)
    rows = docs.select("doc_id", "source", *[c.alias(k) for k, c in own.items()])
    rows = durable(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    if apart:
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
        rows = rows.select("*", copy).withColumns({"key": copy_key(seed, F.col("copy"), F.col("digest")), "words": F.col("size")}).drop("copy")
    else:
        rows = rows.withColumn("words", F.col("size") * F.col("copies"))
    bits = bucket_bits(rows.count())
    rows = rows.withColumn("bucket", F.shiftright("key", 60 - bits))
    placed = prefix_sums(rows, ["source_key"], "bucket", ORDER, "words")

    sizes = rows.groupBy("source_key", "bucket").agg(F.first("source").alias("source"), F.sum("words").alias("words"))
    totals = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most_epochs)
    targets = targets.select(own["source_key"].alias("source_key"), "source_size", "target")
    # One row per source and bucket carries the target, so no task gets all rows of a large source.
    plan = sizes.select("source_key", "bucket").join(targets, "source_key")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    left = F.floor("target") - F.col("epochs") * F.col("source_size")
    return placed.join(plan, ["source_key", "bucket"]).withColumn("epochs", epochs).withColumn("left", left)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """How many words the mix takes of each row of docs (doc_id, text, source).

    Rows of a source are ordered by a hash-random key of doc_id and text, so that reruns agree. A source whose target
    passes its size is repeated in whole epochs; the rest of the target is cut from the order by prefix sums
    of words, so that the row on the cut gives just the part that fits.

    Returns doc_id, source, size, source_size, target, taken. Null text has size 0 and gives nothing, a null
    source is a source of its own (the last), null doc_ids and repeated rows are rows like any other, with keys of their own; very long
    texts are counted whole; other columns are ignored, whatever their names; an empty table gives no rows. Settings: see ordered()
    and source_targets().
    """
    part = F.least("size", F.greatest(F.col("left") - F.col("before"), F.lit(0)))
    taken = (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    return ordered(docs, **settings).select("doc_id", "source", "size", "source_size", "target", taken)


#: Sources up to which the table of cuts is small enough to send to every executor.
SMALL = 10_000


def repeated(docs: DataFrame, *, seed: str = "mix", size: Column | None = None, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    As mix(), but the row on a source's cut comes whole; rows that are equal in doc_id, text and source come alike, and all of them
    where the cut lies among them. Rows without words are not taken, very long ones are taken whole. Columns of any name are kept; an empty
    table gives no rows. What a row needs to know is its source's cut, one row per source: that table is
    broadcast after counting it, or else met by source and salt, so texts are not shuffled for few sources.
    """
    own = own_columns(seed, size)
    at = F.struct("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size", "digest")
    taken = F.when((F.col("before") < F.col("left")) & (F.col("size") > 0), at)
    cuts = durable(ordered(docs, seed=seed, size=size, apart=False, **settings).groupBy("source_key").agg(F.max(taken).alias("cut"), F.first("epochs").alias("epochs")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", *[c.alias(k) for k, c in own.items()])
    if cuts.count() <= SMALL:
        joined = rows.join(F.broadcast(cuts), "source_key")
    else:
        parts = 32
        salted = cuts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        joined = rows.withColumn("part", salt("key", parts)).join(salted, ["source_key", "part"])
    copies = F.col("epochs") + F.coalesce((at <= F.col("cut")).cast("int"), F.lit(0))
    return joined.filter("size > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select("row.*")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~') || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM totals),
placed AS (
  SELECT *, row_number() OVER o AS place,
         coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped_before,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS weight_left
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank)),
free AS (SELECT * FROM placed WHERE cap > (budget - capped_before) * weight / weight_left ORDER BY place LIMIT 1),
targets AS (
  SELECT p.source, p.source_size,
         CASE WHEN f.place IS NULL OR p.place < f.place THEN p.cap::DOUBLE
              ELSE (p.budget - f.capped_before) * p.weight / f.weight_left END AS target
  FROM placed p LEFT JOIN free f ON true),
run AS (
  SELECT r.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM rows r),
joined AS (
  SELECT run.*, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS epochs
  FROM run JOIN targets t ON run.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + least(size, greatest(floor(target)::BIGINT - epochs * source_size - before, 0)))::BIGINT AS taken
FROM joined
"""
