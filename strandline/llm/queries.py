"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, language, mixing, neighbours, packing, quality, resampling, secret_scan, sharding, simhash, spans, suffixes, warc
from .common import shared_dir, table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one ledger: of a first half of the documents by the base rules, then of all by all rules, of which only
    what the first did not see is scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/secrets-{uuid.uuid4().hex}"
    first = F.coalesce(F.xxhash64("doc_id") % 2 == 0, F.lit(True))
    secret_scan.scan(docs.filter(first), rules=secret_scan.BASE, path=ledger)
    scanned, _ = secret_scan.scan(docs, path=ledger)
    return secret_scan.digest(scanned)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.resolve(warc.captures(table(spark, sf_dir, "pages"))))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(found.fp).alias("fingerprint"), "component_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"), keep=False)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language, op3_quality, op4_mixing, op5_spans, op6_packing, op7_warc, op8_neighbours, op9_simhash, op10_secrets, op11_alignment, op12_resampling, op13_suffixes)}
ORACLES = {"op3_quality": quality.ORACLE, "op4_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op10_secrets": secret_scan.ORACLE, "op12_resampling": resampling.ORACLE}
