"""Rows from nested source records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEIGHBOR = "struct<systemId:string,metric:bigint,neighborAddr:string,adjSids:array<struct<adjSid:bigint>>>"
LSP = f"struct<hostname:struct<name:string>,neighbors:array<{NEIGHBOR}>,routerCapabilities:array<struct<routerId:string>>>"
DUMP = f"struct<vrfs:map<string,struct<isisInstances:map<string,struct<level:map<string,struct<lsps:map<string,{LSP}>>>>>>>>"


def flatten_lsdb(dumps: DataFrame, column: str = "dump") -> DataFrame:
    """A link-state dump as rows (system_id, hostname, router_id, neighbor_id, metric, neighbor_addr, adj_sids)."""
    lsps = F.from_json(F.col(column), DUMP)["vrfs"]["default"]["isisInstances"]["1"]["level"]["2"]["lsps"]
    systems = dumps.select(F.explode(lsps).alias("system_id", "lsp"))
    rows = systems.select("system_id", F.col("lsp.hostname.name").alias("hostname"), F.try_element_at("lsp.routerCapabilities", F.lit(1))["routerId"].alias("router_id"), F.explode("lsp.neighbors").alias("n"))
    return rows.select("system_id", "hostname", "router_id", F.col("n.systemId").alias("neighbor_id"), F.col("n.metric").alias("metric"), F.col("n.neighborAddr").alias("neighbor_addr"), F.col("n.adjSids.adjSid").alias("adj_sids"))


def production_rows(df: DataFrame, column: str = "by_identity") -> DataFrame:
    """A map of identity to [slots, blocks] as rows."""
    return df.select(*[c for c in df.columns if c != column], F.explode(column).alias("identity", "v")).select(
        *[c for c in df.columns if c != column], "identity", F.col("v")[0].alias("slots"), F.col("v")[1].alias("blocks")
    )


def vote_rows(current: DataFrame, delinquent: DataFrame, cluster_slot) -> DataFrame:
    """Both sets of vote accounts, flagged, with the last [epoch, credits] of their list."""
    both = current.withColumn("is_delinquent", F.lit(False)).unionByName(delinquent.withColumn("is_delinquent", F.lit(True)))
    last = F.try_element_at(F.from_json("epoch_credits", "array<array<bigint>>"), F.lit(-1))
    return both.withColumns({"credits_epoch": last[0], "credits": last[1], "cluster_slot": cluster_slot}).drop("epoch_credits")


def interface_ips(links: DataFrame, devices: DataFrame) -> DataFrame:
    """links (link_pk, side_a_pk, side_a_iface, side_z_pk, side_z_iface) with the addresses that devices list for those interfaces."""
    ips = devices.select("device_pk", F.explode(F.from_json("interfaces", "array<struct<name:string,ip:string>>")).alias("i"))
    ips = ips.groupBy("device_pk", F.col("i.name").alias("name")).agg(F.min("i.ip").alias("ip"))
    out = links
    for s in ("a", "z"):
        own = ips.select(F.col("device_pk").alias(f"side_{s}_pk"), F.col("name").alias(f"side_{s}_iface"), F.col("ip").alias(f"side_{s}_ip"))
        out = out.join(own, [f"side_{s}_pk", f"side_{s}_iface"], "left")
    return out


def leader_rows(schedule: DataFrame) -> DataFrame:
    """A leader schedule with its slots as text and their number."""
    return schedule.select("node", "epoch", F.to_json("slots").alias("slots"), F.size("slots").cast("long").alias("slot_count"))


def located(ips: DataFrame, ranges: DataFrame, width: int = 65536) -> DataFrame:
    """Distinct addresses (ip_long) with the attributes of their range (low, high, ...); addresses outside all ranges go."""
    from ..operators.joins import range_join

    return range_join(ips.distinct(), "ip_long", ranges, "low", "high", width).drop("low", "high")
