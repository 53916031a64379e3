"""All queries and the SQL that must give the same rows."""

from . import browse_queries, graph_queries, health_queries, history_queries, outage_queries, shape_queries, stake_queries, stream_queries, telemetry_queries, timeline_queries, traffic_queries  # noqa: F401  registers
from .base import ORACLES, QUERIES  # noqa: F401
