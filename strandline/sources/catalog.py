"""What there is to query, and queries as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import finite


def run_sql(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Rows of a query; a semicolon at its end goes, a blank text is an error. Frames are named in braces, args after a colon."""
    text = text.strip().rstrip(";").strip()
    if not text:
        raise ValueError("the query is empty")
    return spark.sql(text, args=args, **frames)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, times as ISO text."""
    kinds = {"double": finite, "float": finite, "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def catalog(frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(table_name, column_name, position, data_type) from the schemas of the tables; no rows are read."""
    rows = [(name, c, i, t) for name, df in frames.items() for i, (c, t) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string")


def categorical_samples(df: DataFrame, most: int = 15) -> DataFrame:
    """(column_name, samples): the values of string columns that have at most `most` of them, ids and times aside.

    One pass counts the columns roughly; a second, over the few that pass, gathers their values.
    """
    names = [c for c, t in df.dtypes if t == "string" and not any(x in c.lower() for x in ("_pk", "hash", "_ts", "time", "uuid"))]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, samples array<string>")
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    few = [c for c in names if rough[c] <= 2 * most]
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in few])).alias("p")).select("p.*") if few else None
    if pairs is None:
        return df.sparkSession.createDataFrame([], "column_name string, samples array<string>")
    values = pairs.filter("v <> ''").distinct().groupBy("column_name").agg(F.sort_array(F.collect_list("v")).alias("samples"))
    return values.filter(F.size("samples") <= most)
