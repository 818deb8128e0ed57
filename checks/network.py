"""Network track: model flow rows, scores, network alerts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks import views
from checks.register import registrar
from nightwarden import fixed_values as fv
from nightwarden.functions import numbers
from nightwarden.plans import network_detection as net

QUERIES, ORACLES, query = registrar()


# A small stand-in network; trained weights are site data.
SCALE = [30000 if n == "DestinationPort" else 2e6 if n == "FlowDurationMs" else 1e6 if n == "FlowBytesPerSec"
         else 5e5 if "IAT" in n else 6e4 if n == "InitWinBytesFwd" else 5000 if n.startswith("Init")
         else 3 if "Flag" in n else 500 for n in fv.MODEL_FEATURES]
MEAN = [s / 4 for s in SCALE]
HIDDEN = 8
W1 = [[((i * 7 + j * 3) % 11 - 5) / 20 for j in range(HIDDEN)] for i in range(len(SCALE))]
B1 = [(j % 3 - 1) / 10 for j in range(HIDDEN)]
W2 = [((j * 5) % 7 - 3) / 3 for j in range(HIDDEN)]
B2 = 2.5


def model() -> net.Model:
    return net.Model([np.array(W1), np.array(W2)[:, None]], [np.array(B1), np.array([B2])], np.array(MEAN), np.array(SCALE))


def p_attack_sql(column=lambda n: n) -> str:
    """Score as plain SQL."""
    terms = lambda j: " + ".join(f"({column(n)} - {m!r}) / {s!r} * {W1[i][j]!r}" for i, (n, m, s) in enumerate(zip(fv.MODEL_FEATURES, MEAN, SCALE)))
    z = " + ".join(f"greatest(0.0, {B1[j]!r} + {terms(j)}) * {W2[j]!r}" for j in range(HIDDEN))
    return f"1 / (1 + exp({B2!r} + {z}))"


FLOW_SQL = f"fl AS ({views.select_sql({**views.FLOW_HEAD, **views.FLOW_FEATURES}, 'lineitem')})"
SKIP = ", ".join(str(p) for p in fv.SKIP_PORTS)
SIGNAL = " OR ".join(f"{n} <> 0" for n in fv.MODEL_FEATURES if n != "DestinationPort")
ATTACK = """CASE WHEN FlowBytesPerSec > 500000 AND AveragePacketSize < 100 THEN 'DDoS / Volumetric Flood'
 WHEN FlowPacketsPerSec > 1000 AND NOT BwdPacketsPerSec > 0 AND AveragePacketSize < 100 THEN 'UDP Flood'
 WHEN FlowDurationMs < 500000 AND TotalFwdPackets <= 3 AND NOT BwdPacketsPerSec > 0 AND MinPacketLength < 100 THEN 'Port Scan'
 WHEN DestinationPort = 22 AND AveragePacketSize < 300 AND TotalFwdPackets < 20 THEN 'SSH Brute Force'
 WHEN DestinationPort = 21 AND AveragePacketSize < 300 AND TotalFwdPackets < 20 THEN 'FTP Brute Force'
 WHEN DestinationPort IN (80, 443, 8080, 8443, 8000) AND FlowBytesPerSec > 2000000 AND BwdPacketsPerSec > 0 THEN 'DoS – HTTP Flood'
 WHEN DestinationPort IN (80, 8080, 8000) AND InitWinBytesFwd >= 65535 AND TotalFwdPackets > 3 AND FlowBytesPerSec > 10000 THEN 'Web Attack'
 WHEN FlowDurationMs > 1000000 AND AveragePacketSize < 200 AND FwdIATStd < 50000 AND BwdIATMax < 2000000 AND BwdPacketsPerSec > 0 THEN 'Botnet C2 Beaconing'
 ELSE 'Network Attack Detected' END"""
META = "meta(name, rule_id, mitre_id, mitre_tactic) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}', '{}')".format(n, *m) for n, m in fv.NETWORK_ATTACKS.items()) + ")"
SCORED = f"""{FLOW_SQL},
kept AS (SELECT * FROM fl WHERE DestinationPort NOT IN ({SKIP}) AND ({SIGNAL})),
sc AS (SELECT *, CAST(floor(FlowStartTime / 30) AS BIGINT) * 30 AS batch_start, {p_attack_sql()} AS p_attack FROM kept),
flag AS (SELECT *, {ATTACK} AS attack_type FROM sc WHERE p_attack >= {fv.ALERT_THRESHOLD}),
flag_n AS (SELECT client_id, batch_start, count(*) AS flow_count FROM flag GROUP BY 1, 2),
times AS (SELECT client_id, batch_start, strftime(make_timestamp(CAST(floor(max(FlowStartTime)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS stamp FROM sc GROUP BY 1, 2)"""
SAME = "{0}.client_id = {1}.client_id AND {0}.batch_start IS NOT DISTINCT FROM {1}.batch_start".format
SEVERITY = "CASE WHEN {0} >= 0.95 THEN 4 WHEN {0} >= 0.85 THEN 3 WHEN {0} >= 0.75 THEN 2 ELSE 1 END".format


def kept(spark, sf_dir):
    return net.scoring_rows(views.flows(spark, sf_dir))


def scored(spark, sf_dir):
    return net.scored(kept(spark, sf_dir), model())


_ODD = {
    "flow_no": "l_orderkey * 10 + l_linenumber",
    " FlowBytesPerSec": "CASE l_orderkey % 5 WHEN 0 THEN 'CORRUPT' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL ELSE CAST(l_quantity AS STRING) END",
    "BwdIATMax ": "CASE WHEN l_orderkey % 4 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 4 = 1 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END",
    "Protocol": "CASE l_linenumber % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'udp' WHEN 2 THEN '6' END",
}


@query("feature_preparation", """
SELECT l_orderkey * 10 + l_linenumber AS flow_no, CASE WHEN l_orderkey % 5 = 4 THEN l_quantity ELSE 0.0 END AS FlowBytesPerSec,
  CASE WHEN l_orderkey % 4 > 1 THEN l_extendedprice ELSE 0.0 END AS BwdIATMax, CAST(0 AS DOUBLE) AS FwdIATStd,
  CASE l_linenumber % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 0 END AS Protocol FROM lineitem""")
def feature_preparation(spark, sf_dir):
    odd = views.project(views.read(spark, sf_dir, "lineitem"), _ODD)
    return net.prepare_features(odd).select("flow_no", "FlowBytesPerSec", "BwdIATMax", "FwdIATStd", "Protocol")


@query("benign_port_skip", f"WITH {FLOW_SQL} SELECT DestinationPort, count(*) AS flows FROM fl WHERE DestinationPort NOT IN ({SKIP}) GROUP BY 1")
def benign_port_skip(spark, sf_dir):
    return net.without_skip_ports(views.flows(spark, sf_dir)).groupBy("DestinationPort").agg(F.count("*").alias("flows"))


@query("signal_filter", f"WITH {FLOW_SQL} SELECT client_id, count(*) AS flows, sum(flow_no) AS check_sum FROM fl WHERE {SIGNAL} GROUP BY 1")
def signal_filter(spark, sf_dir):
    return net.with_signal(net.prepare_features(views.flows(spark, sf_dir))).groupBy("client_id").agg(
        F.count("*").alias("flows"), F.sum("flow_no").alias("check_sum"))


@query("attack_classifier", f"WITH {FLOW_SQL} SELECT flow_no, {ATTACK} AS attack_type FROM fl")
def attack_classifier(spark, sf_dir):
    return views.flows(spark, sf_dir).select("flow_no", net.attack_type().alias("attack_type"))


_CELLS = {"FwdIATStd": "flow_no % 7 = 0", "MaxPacketLength": "flow_no % 11 = 0"}


@query("attack_classifier_cells", f"""WITH {FLOW_SQL}, cells AS (SELECT * REPLACE (CASE WHEN {_CELLS['FwdIATStd']} THEN 0 ELSE FwdIATStd END AS FwdIATStd) FROM fl)
SELECT flow_no, CASE WHEN {_CELLS['MaxPacketLength']} THEN 'Network Attack Detected' ELSE {ATTACK} END AS attack_type FROM cells""")
def attack_classifier_cells(spark, sf_dir):
    """Flows read as text: some lack a figure, some have a word for one."""
    texts = views.flows(spark, sf_dir).withColumns({
        "FwdIATStd": F.expr(f"CASE WHEN {_CELLS['FwdIATStd']} THEN '' ELSE CAST(FwdIATStd AS STRING) END"),
        "MaxPacketLength": F.expr(f"CASE WHEN {_CELLS['MaxPacketLength']} THEN 'n/a' ELSE CAST(MaxPacketLength AS STRING) END")})
    return texts.select("flow_no", net.attack_type().alias("attack_type"))


@query("attack_metadata", f"""WITH {FLOW_SQL}, {META}, t AS (SELECT flow_no, CASE WHEN flow_no % 7 = 0 THEN 'Unheard of' ELSE {ATTACK} END AS attack_type FROM fl)
SELECT flow_no, attack_type, coalesce(m.rule_id, 'net_mlp_detection') AS rule_id, coalesce(m.mitre_id, '') AS mitre_id, coalesce(m.mitre_tactic, '') AS mitre_tactic
FROM t LEFT JOIN meta m ON m.name = t.attack_type""")
def attack_metadata(spark, sf_dir):
    typed = views.flows(spark, sf_dir).select(
        "flow_no", F.when(F.col("flow_no") % 7 == 0, "Unheard of").otherwise(net.attack_type()).alias("attack_type"))
    return net.with_metadata(typed).select("flow_no", "attack_type", "rule_id", "mitre_id", "mitre_tactic")


@query("flow_evidence", "WITH " + FLOW_SQL + " SELECT flow_no, " + ", ".join(f"round({n}, 4) AS {n}" for n in fv.EVIDENCE_FEATURES) + " FROM fl")
def flow_evidence(spark, sf_dir):
    parsed = views.flows(spark, sf_dir).select("flow_no", F.from_json(net.evidence(), "struct<" + ",".join(f"{n}: double" for n in fv.EVIDENCE_FEATURES) + ">").alias("e"))
    return parsed.select("flow_no", "e.*")


@query("batch_timestamp", f"WITH {SCORED} SELECT client_id, batch_start, stamp FROM times")
def batch_timestamp(spark, sf_dir):
    from nightwarden.functions import clock
    return net.batch_times(kept(spark, sf_dir)).select("client_id", "batch_start", clock.iso_seconds(F.col("batch_time")).alias("stamp"))


_STD = ("FlowDurationMs", "FlowBytesPerSec", "BwdIATMax", "AveragePacketSize")
_AT = {n: fv.MODEL_FEATURES.index(n) for n in _STD}


@query("standardise", f"WITH {FLOW_SQL} SELECT flow_no, " + ", ".join(f"round(({n} - {MEAN[i]!r}) / {SCALE[i]!r}, 6) AS {n}" for n, i in _AT.items()) + " FROM fl")
def standardise(spark, sf_dir):
    rows = net.standardised(net.prepare_features(views.flows(spark, sf_dir)), MEAN, SCALE)
    return rows.select("flow_no", *[F.round(n, 6).alias(n) for n in _STD])


@query("mlp_scores", f"WITH {SCORED} SELECT flow_no, round(p_attack, 6) AS p_attack FROM sc")
def mlp_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("flow_no", F.round("p_attack", 6).alias("p_attack"))


SHOWN = ("alert_id", "client_id", "timestamp", "track", "attack_type", "severity", "confidence", "window_start",
         "window_end", "event_count", "rule_id", "mitre_id", "mitre_tactic")


def shown(alerts, *more):
    return alerts.select(*[F.round(c, 6).alias(c) if c == "confidence" else F.col(c) for c in SHOWN], *more)


FLOW_ALERTS = f"""SELECT sha256('flow|' || f.client_id || '|' || CAST(flow_no AS VARCHAR)) AS alert_id, f.client_id, stamp AS timestamp, 2 AS track, attack_type,
  {SEVERITY('p_attack')} AS severity, round(p_attack, 6) AS confidence, stamp AS window_start, stamp AS window_end, 1 AS event_count, rule_id, mitre_id, mitre_tactic
FROM flag f JOIN flag_n n ON {SAME('f', 'n')} AND flow_count <= {fv.BURST_MIN_FLOWS} JOIN times t ON {SAME('f', 't')} JOIN meta ON meta.name = attack_type"""
BURST = f"""burst AS (SELECT client_id, batch_start, count(*) AS flow_count, avg(p_attack) AS mean_conf, max(p_attack) AS max_conf, min(FlowStartTime) AS lo, max(FlowStartTime) AS hi
  FROM flag GROUP BY 1, 2 HAVING count(*) > {fv.BURST_MIN_FLOWS}),
flag_placed AS (SELECT *, row_number() OVER (PARTITION BY client_id, batch_start ORDER BY FlowStartTime NULLS FIRST, flow_no) AS place FROM flag),
types AS (SELECT client_id, batch_start, attack_type, count(*) AS n, min(place) AS seen FROM flag_placed GROUP BY 1, 2, 3),
dom AS (SELECT client_id, batch_start, attack_type FROM types QUALIFY row_number() OVER (PARTITION BY client_id, batch_start ORDER BY n DESC, seen) = 1),
ports AS (SELECT client_id, batch_start, CAST(DestinationPort AS INT) AS port, count(*) AS flows FROM flag GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY client_id, batch_start ORDER BY flows DESC, port) AS place FROM ports QUALIFY place <= {fv.TOP_PORTS}),
top_list AS (SELECT client_id, batch_start, string_agg(CAST(port AS VARCHAR) || ':' || CAST(flows AS VARCHAR), ',' ORDER BY place) AS top_ports FROM top GROUP BY 1, 2)"""
ISO = "strftime(make_timestamp(CAST(floor({0}) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')".format
BURST_ALERTS = f"""SELECT sha256('burst|' || b.client_id || coalesce('|' || CAST(b.batch_start AS VARCHAR), '')) AS alert_id, b.client_id, stamp AS timestamp, 2 AS track, d.attack_type,
  {SEVERITY('mean_conf')} AS severity, round(mean_conf, 6) AS confidence, coalesce({ISO('lo')}, stamp) AS window_start, coalesce({ISO('hi')}, stamp) AS window_end,
  CAST(flow_count AS INT) AS event_count, rule_id, mitre_id, mitre_tactic
FROM burst b JOIN dom d ON {SAME('b', 'd')} JOIN times t ON {SAME('b', 't')} JOIN meta ON meta.name = d.attack_type"""
RULES = f"""figures AS (SELECT client_id, batch_start, count_if(scan) AS scan_flows, count(DISTINCT CASE WHEN scan THEN DestinationPort END) AS scan_ports, count_if(flood) AS flood_flows FROM (
  SELECT *, TotalFwdPackets <= 2 AND AveragePacketSize < 100 AND FINFlagCount = 0 AND PSHFlagCount = 0 AS scan,
   ACKFlagCount = 0 AND FINFlagCount = 0 AND PSHFlagCount = 0 AND FlowBytesPerSec > 0 AND BwdPacketsPerSec = 0 AND TotalFwdPackets > 2
   AND DestinationPort NOT IN ({', '.join(map(str, fv.FLOOD_EXCLUDED_PORTS))}) AS flood FROM sc) GROUP BY 1, 2)"""


def rule_hits_sql(scan_flows=fv.PORTSCAN_MIN_FLOWS, scan_ports=fv.PORTSCAN_MIN_PORTS, flood_flows=fv.FLOOD_MIN_FLOWS) -> str:
    return f"""rule_hits AS (SELECT client_id, batch_start, 'Port Scan' AS attack_type, scan_flows AS flow_count,
  scan_ports AS port_count
  FROM figures WHERE scan_flows >= {scan_flows} AND scan_ports >= {scan_ports}
 UNION ALL SELECT client_id, batch_start, 'UDP Flood', flood_flows, NULL
  FROM figures WHERE flood_flows >= {flood_flows})"""


# The test rows are thinner than real traffic, so the checks lower the thresholds.
LOW = {"scan_flows": 3, "scan_ports": 2, "flood_flows": 6}
RULE_ALERTS = f"""SELECT sha256('batch|' || rule_id || '|' || h.client_id || coalesce('|' || CAST(h.batch_start AS VARCHAR), '')) AS alert_id, h.client_id, stamp AS timestamp, 2 AS track, attack_type,
  3 AS severity, CAST(0.9 AS DOUBLE) AS confidence, stamp AS window_start, stamp AS window_end, CAST(flow_count AS INT) AS event_count, rule_id, mitre_id, mitre_tactic
FROM rule_hits h JOIN times t ON {SAME('h', 't')} JOIN meta ON meta.name = attack_type"""


@query("flow_alerts", f"WITH {SCORED}, {META}\n{FLOW_ALERTS}")
def flow_alerts(spark, sf_dir):
    return shown(net.flow_alerts(scored(spark, sf_dir)))


@query("burst_summary", f"""WITH {SCORED}, {BURST}
SELECT b.client_id, b.batch_start, flow_count, round(mean_conf, 6) AS mean_conf, round(max_conf, 6) AS max_conf, lo AS first_start, hi AS last_start, attack_type, top_ports
FROM burst b JOIN dom d ON {SAME('b', 'd')} LEFT JOIN top_list p ON {SAME('b', 'p')}""")
def burst_summary(spark, sf_dir):
    rows = net.burst_summaries(scored(spark, sf_dir))
    ports = F.array_join(F.transform(F.map_entries("top_ports"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return rows.select("client_id", "batch_start", "flow_count", F.round("mean_conf", 6).alias("mean_conf"),
                       F.round("max_conf", 6).alias("max_conf"), "first_start", "last_start", "attack_type", ports.alias("top_ports"))


@query("burst_alerts", f"WITH {SCORED}, {META}, {BURST}\n{BURST_ALERTS}")
def burst_alerts(spark, sf_dir):
    return shown(net.burst_alerts(scored(spark, sf_dir)))


@query("top_ports", f"WITH {SCORED}, {BURST} SELECT client_id, batch_start, port, flows, CAST(place AS INT) AS place FROM top")
def top_ports(spark, sf_dir):
    return net.top_ports(net.flagged(scored(spark, sf_dir))).select("client_id", "batch_start", "port", "flows", "place")


@query("dominant_types", f"WITH {SCORED}, {BURST} SELECT client_id, batch_start, attack_type FROM dom")
def dominant_types(spark, sf_dir):
    return net.dominant_types(net.flagged(scored(spark, sf_dir))).select("client_id", "batch_start", "attack_type")


@query("portscan_batches", f"WITH {SCORED}, {RULES} SELECT client_id, batch_start, scan_flows, scan_ports FROM figures WHERE scan_flows > 0")
def portscan_batches(spark, sf_dir):
    return net.batch_rule_counts(kept(spark, sf_dir)).filter("scan_flows > 0").select("client_id", "batch_start", "scan_flows", "scan_ports")


@query("udp_flood_batches", f"WITH {SCORED}, {RULES} SELECT client_id, batch_start, flood_flows FROM figures WHERE flood_flows > 0")
def udp_flood_batches(spark, sf_dir):
    return net.batch_rule_counts(kept(spark, sf_dir)).filter("flood_flows > 0").select("client_id", "batch_start", "flood_flows")


@query("batch_rule_hits", f"WITH {SCORED}, {RULES}, {rule_hits_sql(**LOW)} SELECT * FROM rule_hits")
def batch_rule_hits(spark, sf_dir):
    return net.batch_rule_hits(kept(spark, sf_dir), **LOW).drop("batch_time")


DAYS = SCORED.replace("/ 30) AS BIGINT) * 30", "/ 864000) AS BIGINT) * 864000")


@query("batch_rules_by_default", f"WITH {DAYS}, {RULES}, {rule_hits_sql()} SELECT * FROM rule_hits")
def batch_rules_by_default(spark, sf_dir):
    """Both batch rules at their own limits, over batches long enough to reach them."""
    return net.batch_rule_hits(net.scoring_rows(views.flows(spark, sf_dir), seconds=864000)).drop("batch_time")


@query("batch_rule_alerts", f"WITH {SCORED}, {META}, {RULES}, {rule_hits_sql(**LOW)} {RULE_ALERTS}")
def batch_rule_alerts(spark, sf_dir):
    return shown(net.batch_rule_alerts(kept(spark, sf_dir), **LOW))


@query("network_alerts", f"WITH {SCORED}, {META}, {BURST}, {RULES}, {rule_hits_sql()} {FLOW_ALERTS} UNION ALL {BURST_ALERTS} UNION ALL {RULE_ALERTS}")
def network_alerts(spark, sf_dir):
    return shown(net.network_alerts(scored(spark, sf_dir)))


@query("batch_counters", f"""WITH {SCORED}, {RULES}, {rule_hits_sql(**LOW)}
SELECT s.client_id, s.batch_start, rows_read, flagged + coalesce(n, 0) AS attacks, rows_read - flagged AS benign
FROM (SELECT client_id, batch_start, count(*) AS rows_read, count_if(p_attack >= {fv.ALERT_THRESHOLD}) AS flagged FROM sc GROUP BY 1, 2) s
LEFT JOIN (SELECT client_id, batch_start, count(*) AS n FROM rule_hits GROUP BY 1, 2) h ON {SAME('s', 'h')}""")
def batch_counters(spark, sf_dir):
    return net.batch_counters(scored(spark, sf_dir), **LOW)


@query("score_histogram", f"WITH {SCORED} " + " UNION ALL ".join(
    f"SELECT CAST({c} AS DOUBLE) AS cut, count_if(p_attack >= {c}) AS rows FROM sc" for c in fv.SCORE_CUTS))
def score_histogram(spark, sf_dir):
    return net.score_histogram(scored(spark, sf_dir))


@query("column_profile", f"WITH {FLOW_SQL} " + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, true AS present, round(avg({n}), 6) AS mean, max({n}) AS max FROM fl" for n in fv.PROFILE_FEATURES[:3])
    + f" UNION ALL SELECT '{fv.PROFILE_FEATURES[3]}', false, NULL, NULL")
def column_profile(spark, sf_dir):
    rows = views.flows(spark, sf_dir).drop(fv.PROFILE_FEATURES[3])
    return net.column_profile(rows).withColumn("mean", F.round("mean", 6))


@query("top_scored_flows", f"WITH {SCORED} SELECT flow_no, round(p_attack, 6) AS p_attack, DestinationPort, FlowDurationMs FROM sc ORDER BY sc.p_attack DESC, flow_no LIMIT 15")
def top_scored_flows(spark, sf_dir):
    return net.top_scored(scored(spark, sf_dir)).select("flow_no", F.round("p_attack", 6).alias("p_attack"), "DestinationPort", "FlowDurationMs")


@query("short_flow_sample", f"WITH {SCORED} SELECT flow_no, round(p_attack, 6) AS p_attack, FlowDurationMs FROM sc WHERE FlowDurationMs < 1000 ORDER BY flow_no LIMIT 10")
def short_flow_sample(spark, sf_dir):
    return net.short_flows(scored(spark, sf_dir)).select("flow_no", F.round("p_attack", 6).alias("p_attack"), "FlowDurationMs")


@query("confidence_severity", f"WITH {SCORED} SELECT {SEVERITY('p_attack')} AS severity, count(*) AS flows FROM flag GROUP BY 1")
def confidence_severity(spark, sf_dir):
    return net.flagged(scored(spark, sf_dir)).groupBy(numbers.severity(F.col("p_attack")).alias("severity")).agg(F.count("*").alias("flows"))
