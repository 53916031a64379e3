"""Ratios, rates and losses as the analyses define them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.nullif(y, F.lit(0))


def percent(cond: Column) -> Column:
    """Share of rows for which cond holds, in percent."""
    return F.count_if(cond) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))


def is_lost(loss: Column, rtt: Column, *, strict: bool = True) -> Column:
    """A sample is lost if it says so or, when strict, if its round trip is 0."""
    return (loss | (rtt == 0)) if strict else loss


def mean_rate(octets: Column, seconds: Column) -> Column:
    """Bits per second over the whole time."""
    return ratio(F.sum(octets) * 8, F.sum(seconds))


def peak_rate(octets: Column, seconds: Column) -> Column:
    """The highest rate of a single row."""
    return F.max(ratio(octets * 8, seconds))


def clamped_sum(delta: Column) -> Column:
    """Sum of deltas; negative ones, from counter resets, and nulls count as 0."""
    return F.sum(F.greatest(F.lit(0), F.coalesce(delta, F.lit(0))))


def weighted_mean(x: Column, n: Column) -> Column:
    return ratio(F.sum(x * n), F.sum(n))


def finite(x: Column) -> Column:
    """x, or null if it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))
