"""Places of addresses: the longest network that holds each, and a table of them that is only added to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import bits, prefix


def addresses(feeds: list[DataFrame]) -> DataFrame:
    """(ip): the addresses of all feeds (ip), each once; nulls, blanks and what is no address go."""
    every = reduce(DataFrame.unionByName, [f.select("ip") for f in feeds])
    return every.filter(bits(F.col("ip")).isNotNull()).distinct()


def longest_prefix(ips: DataFrame, networks: DataFrame) -> DataFrame:
    """ips (ip) with the attributes of the longest of networks (network, ...) that holds each; those that none holds go.

    Each distinct address meets the networks under its first n bits, for each length n that networks have: an equi-join, 129 lengths at
    most, whatever the number of networks. Lengths are one small row set; networks are shuffled, never broadcast by force. Of equal networks
    the one with the greatest attributes counts.
    """
    named = networks.withColumn("__bits", prefix(F.col("network"))).filter("__bits IS NOT NULL")
    attributes = [c for c in networks.columns]
    lengths = named.agg(F.collect_set(F.length("__bits")).alias("__lengths"))  # 129 at most
    asked = ips.select("ip", bits(F.col("ip")).alias("__own")).filter("__own IS NOT NULL").distinct().crossJoin(F.broadcast(lengths))
    asked = asked.select("ip", F.explode("__lengths").alias("__n"), "__own").select("ip", F.substring(F.col("__own"), F.lit(1), F.col("__n")).alias("__bits"))
    met = asked.join(named, "__bits")
    best = met.groupBy("ip").agg(F.max(F.struct(F.length("__bits").alias("n"), *attributes)).alias("b"))
    return best.select("ip", *[f"b.{c}" for c in attributes])


def upsert(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """table with the rows of fresh put in their key's place, and new ones added; nothing is deleted. One aggregate, no join."""
    rest = [c for c in table.columns if c != key]
    row = F.struct(*rest)
    both = table.select(key, F.lit(0).alias("__new"), row.alias("__row")).unionByName(fresh.select(key, F.lit(1).alias("__new"), row.alias("__row")))
    return both.groupBy(key).agg(F.max(F.struct("__new", "__row")).alias("m")).select(key, "m.__row.*").select(*table.columns)
