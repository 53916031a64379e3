"""The current state of entities as a snapshot and the log since: reading it costs their size, and not that of the history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scd2


def append(rows: DataFrame, root: str, number: int) -> None:
    """Write rows of history as part `number` of the log, numbers rising. A repeated part overwrites its own."""
    rows.write.mode("overwrite").parquet(f"{root}/log/part={number}")


def _parts(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, part long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _last(df: DataFrame | None) -> int:
    """The highest part number, from the folders' names: no column is read."""
    found = None if df is None else df.agg(F.max("part")).first()[0]
    return -1 if found is None else found


def latest_rows(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version of each entity, deleted or not. Of the log, only parts after the snapshot are read."""
    snapshot, log = _parts(spark, f"{root}/snapshot", schema), _parts(spark, f"{root}/log", schema)
    upto = _last(snapshot)
    rows = spark.createDataFrame([], schema)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.filter(F.col("part") == upto).drop("part"))
    if log is not None:
        rows = rows.unionByName(log.filter(F.col("part") > upto).drop("part"))
    return scd2.latest(rows)


def compact(spark: SparkSession, root: str, schema: str, *, files: int = 8) -> None:
    """Write a new snapshot of all that the log has. It counts once it is whole; entities are dealt over the files by hash."""
    upto = _last(_parts(spark, f"{root}/log", schema))
    if upto > _last(_parts(spark, f"{root}/snapshot", schema)):
        latest_rows(spark, root, schema).repartition(files, "entity_id").write.mode("overwrite").parquet(f"{root}/snapshot/part={upto}")


def delta(spark: SparkSession, root: str, schema: str, snapshot: DataFrame, attrs: list[str], *, at: Column, op_id: Column, missing_means_deleted: bool = False) -> DataFrame:
    """scd2.delta() against the snapshot and the log since, instead of the whole history. at should be no earlier than the log."""
    return scd2.delta(latest_rows(spark, root, schema), snapshot, attrs, at=at, op_id=op_id, missing_means_deleted=missing_means_deleted)
