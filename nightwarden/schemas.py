"""Schemas (DDL) of the tables the plans exchange."""

from __future__ import annotations

from nightwarden import fixed_values as fv

HOST_EVENTS = (
    "log_id BIGINT, provider STRING, event_id INT, event_code STRING, level STRING, channel STRING, "
    "computer STRING, event_time TIMESTAMP, data MAP<STRING,STRING>, raw_xml STRING"
)
PACKETS = (
    "client_id STRING, seq BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol INT, "
    "ts_us BIGINT, payload_bytes INT, header_bytes INT, tcp_window INT, flag_fin BOOLEAN, "
    "flag_syn BOOLEAN, flag_rst BOOLEAN, flag_psh BOOLEAN, flag_ack BOOLEAN, flag_urg BOOLEAN, "
    "flag_cwe BOOLEAN, flag_ece BOOLEAN"
)
MODEL_FLOWS = ", ".join(f"{name} DOUBLE" for name in (*fv.MODEL_FEATURES, "FlowStartTime"))
LAYER = "STRUCT<values: ARRAY<DOUBLE>, rows: INT, cols: INT>"
WEIGHTS = (
    f"coefs ARRAY<{LAYER}>, intercepts ARRAY<{LAYER}>, scaler_mean ARRAY<DOUBLE>, "
    "scaler_scale ARRAY<DOUBLE>"
)
MODELS = (
    f"track INT, round INT, version STRING, client_count INT, updated_at DOUBLE, {WEIGHTS}"
)
