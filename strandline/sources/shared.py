"""Results that end their lineage, in the folder that all machines see."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only on a single machine where none is named, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Whether a query's shuffle files go as soon as it ends, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """As durable(), for steps that move much and leave little: the shuffle files it takes are gone when it is there."""
    spark = df.sparkSession
    was = spark.conf.get(TIDY)
    try:
        spark.conf.set(TIDY, "true")
        return durable(df.select("*"))  # planned under that setting
    finally:
        spark.conf.set(TIDY, was)
