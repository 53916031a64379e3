"""Tables in and out: declared schemas, snapshots from raw records, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str, blank_is_null: bool = True) -> DataFrame:
    """A table with a declared schema; empty strings, which stand for missing values, become null."""
    df = spark.read.schema(schema).parquet(path)
    if not blank_is_null:
        return df
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def outage_csv_rows(report: DataFrame) -> DataFrame:
    """An outage report with a column that says it in words."""
    kind = F.create_map(*[F.lit(x) for x in ("loss", "packet loss", "status", "drained", "no_data", "no data")])[F.col("kind")]
    minutes = F.floor(F.unix_micros("end_ts") / 60_000_000) - F.floor(F.unix_micros("start_ts") / 60_000_000)
    return report.withColumn("detail", F.concat(kind, F.lit(" for "), F.coalesce(F.concat(minutes.cast("string"), F.lit(" min")), F.lit("now"))))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def host_port(text: Column) -> Column:
    """(host, port) of host:port; nulls where a part is missing."""
    host = F.nullif(F.regexp_extract(text, r"^(.*):\d+$", 1), F.lit(""))
    return F.struct(host.alias("host"), F.regexp_extract(text, r":(\d+)$", 1).try_cast("int").alias("port"))


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """df, or an error if it is empty: a source that returns nothing must not delete all entities."""
    if df.isEmpty():
        raise ValueError(f"{name} is empty")
    return df
