"""What the operators of this subpackage share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see, which spark.checkpoint.dir names; a temporary one only on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines see")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lineage ends here, and lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether a query's shuffle files go as soon as it ends, and not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """For work in many steps that durable() and stored() keep: the shuffle files of a step are gone before the next."""
    was = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, was)


def salt_count(rows: int) -> int:
    """Parts into which the rows of one key are dealt, so that a key with a third of all rows gives parts of bounded size."""
    return max(64, math.ceil(rows / 1_000_000))


def salt(column: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def bucket_bits(rows: int, per_bucket: int = 4096) -> int:
    """Bits of a uniform key that name a bucket of about per_bucket rows."""
    return max(6, math.ceil(math.log2(max(rows, 1) / per_bucket)))


def hash60(seed: str, *columns: Column) -> Column:
    """A uniform 60-bit number from MD5 of the seed and the columns as text; nulls count as '~'."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running(value: str, keys: list[str], order: list, *, inclusive: bool = False) -> Column:
    """Sum of value over the rows before this one (and this one, if inclusive), 0 for none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


#: Buckets whose totals are added up together.
FAN = 1024


def prefix_sums(rows: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str = "before") -> DataFrame:
    """rows with the sum of value over all rows of the same keys that come before, by (bucket, order).

    No task sees more than one bucket of a key: sums run within buckets; those of earlier buckets are added up over FAN
    buckets at a time, and then over those groups. bucket must rise with the order, from 0 on; keys must not be null.
    """
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("__total")).withColumn("__group", F.floor(F.col(bucket) / FAN))
    groups = totals.groupBy(*keys, "__group").agg(F.sum("__total").alias("__sum"))
    groups = groups.withColumn("__earlier", running("__sum", keys, ["__group"])).drop("__sum")
    inside = totals.withColumn("__near", running("__total", [*keys, "__group"], [bucket])).drop("__total")
    offsets = inside.join(groups, [*keys, "__group"]).select(*keys, bucket, (F.col("__earlier") + F.col("__near")).alias("__offset"))
    local = rows.withColumn("__local", running(value, [*keys, bucket], order))
    return local.join(offsets, [*keys, bucket]).withColumn(out, F.col("__offset") + F.col("__local")).drop("__offset", "__local")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of a few MB for the rest of the session, unless it names a size: texts differ a thousandfold in length, and
    a worker holds a batch several times over."""
    if spark.conf.get(BATCH_BYTES) in ("67108864b", "64MB"):  # Spark's own default
        spark.conf.set(BATCH_BYTES, size)


def stored(df: DataFrame, name: str) -> DataFrame:
    """As durable(), as a compressed Parquet table in the shared folder: for what is too large to keep as rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
