"""Filters, sorting and paging from what a user types."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a unit multiplies by, for each kind of field; '' is no unit.
UNITS = {
    "number": {"": 1.0, "k": 1e3, "m": 1e6},
    "stake": {"": 1.0, "k": 1e3, "m": 1e6},
    "bandwidth": {"": 1e9, "gbps": 1e9, "mbps": 1e6, "kbps": 1e3, "bps": 1.0},
}
#: Preset ranges in hours, and bucket seconds with the longest range, in hours, that uses them.
RANGES = {"1h": 1, "3h": 3, "6h": 6, "12h": 12, "24h": 24, "3d": 72, "7d": 168, "14d": 336, "30d": 720}
BUCKETS = ((1, 10), (3, 30), (6, 60), (12, 120), (24, 300), (72, 900), (168, 1800), (720, 3600))


#: Comparisons that a text may begin with.
COMPARISONS = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, "==": lambda c, v: c == v,
}


def numeric(column: Column, text: str, kind: str = "number") -> Column | None:
    """A predicate from text like '>10k' or '<= 5gbps'; None if the text is none."""
    text = text.strip()
    sign = max((c for c in COMPARISONS if text.startswith(c)), key=len, default=None)
    if sign is None:
        return None
    rest = text[len(sign) :].strip().lower()
    number = rest.rstrip("abcdefghijklmnopqrstuvwxyz")
    unit, digits = rest[len(number) :], number.removeprefix("-").split(".", 1)
    if unit not in UNITS[kind] or not all(d.isascii() and d.isdigit() for d in digits):
        return None
    return COMPARISONS[sign](column, float(number) * UNITS[kind][unit])


def boolean(column: Column, text: str) -> Column | None:
    said = text.strip().lower()
    return column if said in ("yes", "true", "1") else ~column if said in ("no", "false", "0") else None


def contains(columns: list[str], text: str) -> Column:
    """Any of the columns has the text, in any case."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns])


def all_terms(columns: list[str], text: str) -> Column:
    """Every word of the text is in some column."""
    return reduce(lambda a, b: a & b, [contains(columns, w) for w in text.split()], F.lit(True))


def typed_terms(fields: dict[str, str], columns: list[str], terms: list[str]) -> Column:
    """Any of the terms; 'device:abc' looks in the column of that field alone, other terms in all."""
    found = F.lit(False)
    for t in terms:
        name, sep, rest = t.partition(":")
        found = found | (contains([fields[name]], rest) if sep and name in fields else contains(columns, t))
    return found


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0, most: int = 1000, usual: int = 100) -> DataFrame:
    """One page of the sorted rows; at most `most` rows."""
    size = usual if not limit or limit < 1 else min(limit, most)
    return df.orderBy(*order).offset(max(0, offset)).limit(size)


def sort_by(field: str | None, direction: str | None, allowed: dict[str, str], usual: str) -> Column:
    """A sort order from user input: only allowed fields, descending unless told otherwise."""
    c = F.col(allowed.get(field or "", allowed[usual]))
    return c.asc() if (direction or "").lower() == "asc" else c.desc()


def time_range(preset: str | None = None, start: datetime | None = None, end: datetime | None = None, *, now: datetime, bucket: int | None = None) -> tuple[datetime, datetime, int]:
    """(start, end, bucket seconds) of a preset or of explicit times; the bucket grows with the range."""
    if start is None or end is None or start >= end:
        start, end = now - timedelta(hours=RANGES.get(preset or "", RANGES["12h"])), now
    hours = (end - start).total_seconds() / 3600
    return start, end, bucket or next((s for h, s in BUCKETS if hours <= h), BUCKETS[-1][1])


def search(entities: list[tuple[str, DataFrame, str, str, list[str]]], text: str, n: int, order: dict[str, str] | None = None) -> DataFrame:
    """The first n rows of each kind that match all words, with the total of the kind.

    entities: (kind, rows, id column, label column, searched columns). 'kind:words' searches one kind. order: kinds whose rows come by
    a column, the greatest first, before the label.
    """
    order = order or {}
    scope, sep, rest = text.partition(":")
    kinds = [e[0] for e in entities]
    if sep and scope in kinds:
        entities, text = [e for e in entities if e[0] == scope], rest
    parts = [
        df.filter(all_terms(columns, text)).select(F.lit(kind).alias("kind"), F.col(pk).cast("string").alias("pk"), F.col(label).alias("label"), (F.col(order[kind]).cast("double") if kind in order else F.lit(0.0)).alias("weight"))
        for kind, df, pk, label, columns in entities
    ]
    found = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("kind")
    ranked = found.withColumn("n", F.row_number().over(w.orderBy(F.col("weight").desc(), "label", "pk")).cast("long")).withColumn("total", F.count("*").over(w))
    return ranked.filter(F.col("n") <= n).select("kind", "pk", "label", "n", "total")


def field_values(df: DataFrame, field: str, scope: Column | None = None, limit: int = 100) -> DataFrame:
    rows = df if scope is None else df.filter(scope)
    return rows.filter(F.col(field).isNotNull()).select(F.col(field).cast("string").alias("value")).distinct().orderBy("value").limit(limit)


def dimensions(df: DataFrame, filters: dict[str, str], dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """df limited by comma-separated values per field; a field of a dimension table joins that table, others none.

    dims: field -> (table, key that df shares with it).
    """
    for field, values in filters.items():
        if not values:
            continue
        wanted = values.split(",")
        if field in dims:
            table, key = dims[field]
            df = df.join(table.filter(F.col(field).isin(wanted)).select(key), key, "left_semi")
        else:
            df = df.filter(F.col(field).cast("string").isin(wanted))
    return df
