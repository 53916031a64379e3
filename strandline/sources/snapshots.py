"""Snapshots of the network's six kinds of entities, as rows of one shape a kind, refused as a whole if a required kind is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import require_rows

#: The columns of each kind beside its key, and the kinds without which nothing is written, since whatever is missing counts as deleted.
KINDS = {
    "contributors": ["code", "name"],
    "devices": ["status", "device_type", "code", "public_ip", "contributor_pk", "metro_pk", "max_users"],
    "users": ["owner_pubkey", "status", "kind", "client_ip", "dz_ip", "device_pk", "tunnel_id"],
    "metros": ["code", "name", "longitude", "latitude"],
    "links": ["status", "code", "side_a_pk", "side_z_pk", "contributor_pk", "side_a_ip", "side_z_ip", "link_type", "committed_rtt_ns", "committed_jitter_ns", "bandwidth_bps", "delay_override_ns"],
    "multicast_groups": ["owner_pubkey", "code", "multicast_ip", "max_bandwidth", "status", "publisher_count", "subscriber_count"],
}
REQUIRED = ("contributors", "devices", "metros")
#: States of multicast groups by their number; others are unknown.
GROUP_STATES = {0: "pending", 1: "activated", 2: "suspended", 3: "deleted"}


def group_state(number):
    """The name of a multicast group's state."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in GROUP_STATES.items() for x in kv])[number.cast("int")], F.lit("unknown"))


def with_addresses(links: DataFrame, interfaces: DataFrame) -> DataFrame:
    """links with side_a_ip and side_z_ip, the addresses of the interfaces that they end at, null where there is none.

    links: side_a_pk, side_a_iface, side_z_pk, side_z_iface; interfaces: device_pk, intf, ip with or without a length. One join a side.
    """
    bare = interfaces.select("device_pk", "intf", F.split_part("ip", F.lit("/"), F.lit(1)).alias("ip")).dropDuplicates(["device_pk", "intf"])
    for s in ("a", "z"):
        own = bare.select(F.col("device_pk").alias(f"side_{s}_pk"), F.col("intf").alias(f"side_{s}_iface"), F.col("ip").alias(f"side_{s}_ip"))
        links = links.join(own, [f"side_{s}_pk", f"side_{s}_iface"], "left")
    return links


def snapshots(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each kind's rows (entity_id and the columns of KINDS) from its source (pk and columns; those it lacks are null).

    Required kinds are looked at before any rows are returned, so a source that gives nothing never deletes all there is of another.
    Other kinds may be empty or missing. Unknown kinds are an error. A state of groups that is a number gets its name.
    """
    unknown = set(sources) - set(KINDS)
    if unknown:
        raise ValueError(f"no such kind: {', '.join(sorted(unknown))}")
    for kind in REQUIRED:
        if kind not in sources:
            raise ValueError(f"{kind} is empty")
        require_rows(sources[kind], kind)
    out = {}
    for kind, df in sources.items():
        held = dict(df.dtypes)
        if kind == "multicast_groups" and held.get("status", "string") != "string":
            df = df.withColumn("status", group_state(F.col("status")))
        columns = [F.col(c).cast("string").alias(c) if c in held else F.lit(None).cast("string").alias(c) for c in KINDS[kind]]
        out[kind] = df.select(F.col("pk").cast("string").alias("entity_id"), *columns)
    return out
