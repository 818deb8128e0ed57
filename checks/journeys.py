"""Whole journeys over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import network, network_flows
from checks.register import registrar
from nightwarden import fixed_values as fv
from nightwarden.plans import flows, network_detection as net

QUERIES, ORACLES, query = registrar()

_FEATURES = ", ".join(
    f'CASE WHEN isfinite(CAST("{source}" AS DOUBLE)) THEN CAST("{source}" AS DOUBLE) ELSE 0.0 END AS {name}'
    for name, source in fv.MODEL_FEATURE_SOURCES.items())
FROM_PACKETS = (f"{network_flows.ALL_FLOW_CTES}, fl AS (SELECT flow_seq AS flow_no, pk.client_id, {_FEATURES}, round(start_us / 1000000.0, 6) AS FlowStartTime "
                f"FROM flows84 JOIN pk ON pk.seq = flow_seq)" + network.SCORED.removeprefix(network.FLOW_SQL))


@query("packets_to_alerts", f"{FROM_PACKETS}, {network.META}, {network.BURST}, {network.RULES}, {network.rule_hits_sql()} "
                            f"{network.FLOW_ALERTS} UNION ALL {network.BURST_ALERTS} UNION ALL {network.RULE_ALERTS}")
def packets_to_alerts(spark, sf_dir):
    """Packets to flows to features to scores to alerts, all in one."""
    features = flows.packet_features(network_flows.packets(spark, sf_dir))
    rows = flows.model_rows(features, "client_id", F.col("anchor_order").alias("flow_no"))
    return network.shown(net.network_alerts(net.scored(net.scoring_rows(rows), network.model())))
