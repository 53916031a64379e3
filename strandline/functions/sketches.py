"""Quantile sketches as rows: log-linear buckets with counts, which merge by adding up. Kept per hour, they serve any longer span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each power of two, as a number of bits: a bucket's low edge is below its values by less than 1 part in 2**BITS.
BITS = 7


def low_edge(value: Column, bits: int = BITS) -> Column:
    """The low edge of the bucket of a whole number from 0 on; numbers below 2**(bits + 1) have one each."""
    shift = F.greatest(F.length(F.bin(value)) - (bits + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(rows: DataFrame, keys: list[str], value: Column, *, scale: float = 1.0, bits: int = BITS) -> DataFrame:
    """(keys, low, n): how many values fall into each bucket. Values are taken in units of 1 / scale, rounded; nulls and negative ones
    are left out. At most some (63 - bits) * 2**bits rows a key, whatever the number of values; counts are summed map-side."""
    whole = F.round(value * scale).cast("long")
    return rows.select(*keys, whole.alias("__v")).filter("__v >= 0").groupBy(*keys, low_edge(F.col("__v"), bits).alias("low")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys as those of coarser ones."""
    return sketches.groupBy(*keys, "low").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, float], *, scale: float = 1.0) -> DataFrame:
    """(keys, n, and a column for each wanted share): the low edge of the bucket that holds the value of rank ceil(share * n).

    So it is at most that value, rounded to the scale, and above it less 1 part in 2**bits. One window over a key's buckets, whose number is bounded.
    """
    w = Window.partitionBy(*keys)
    ranked = merged(sketches, keys).withColumns({"__all": F.sum("n").over(w), "__upto": F.sum("n").over(w.orderBy("low"))})
    pick = lambda q: F.min(F.when(F.col("__upto") >= F.greatest(F.ceil(F.col("__all") * q), F.lit(1)), F.col("low"))) / scale
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), *[pick(q).alias(k) for k, q in wanted.items()])
