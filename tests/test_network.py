"""Network detection: every branch of the classifier and the batch limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightwarden import fixed_values as fv
from nightwarden.plans import network_detection as net

NAN = float("nan")


def rows(spark, *changes, **common):
    names = [*fv.MODEL_FEATURES, "FlowStartTime", "p_attack"]
    data = []
    for i, change in enumerate(changes):
        values = {**dict.fromkeys(names, 0.0), "FlowStartTime": 1000.0, **common, **change}
        data.append((i, values.pop("client_id", "c"), *[float(values[n]) for n in names]))
    return spark.createDataFrame(data, "flow_no long, client_id string, " + ", ".join(f"{n} double" for n in names))


def batches(spark, *changes, **common):
    return net.batch_of(rows(spark, *changes, **common))


def test_classifier_branches(spark):
    talk = {"BwdPacketsPerSec": 1, "FlowDurationMs": 600_000}
    cases = [
        ({"FlowBytesPerSec": 500_001}, "DDoS / Volumetric Flood"),
        ({"FlowPacketsPerSec": 1_001}, "UDP Flood"),
        ({}, "Port Scan"),
        ({**talk, "DestinationPort": 22}, "SSH Brute Force"),
        ({**talk, "DestinationPort": 21}, "FTP Brute Force"),
        ({**talk, "DestinationPort": 8443, "FlowBytesPerSec": 2_000_001, "AveragePacketSize": 100}, "DoS – HTTP Flood"),
        ({**talk, "DestinationPort": 8000, "InitWinBytesFwd": 65535, "TotalFwdPackets": 4, "FlowBytesPerSec": 10_001}, "Web Attack"),
        ({**talk, "FlowDurationMs": 1_000_001, "DestinationPort": 9}, "Botnet C2 Beaconing"),
        ({**talk, "DestinationPort": 9}, "Network Attack Detected"),
        # NaN compares false, so "no answer" holds and sizes are not small.
        ({"FlowBytesPerSec": NAN, "BwdPacketsPerSec": NAN}, "Port Scan"),
        ({"FlowBytesPerSec": 600_000, "AveragePacketSize": NAN, "TotalFwdPackets": NAN}, "Network Attack Detected"),
    ]
    got = rows(spark, *[c for c, _ in cases]).select("flow_no", net.attack_type().alias("t")).orderBy("flow_no").collect()
    assert [r.t for r in got] == [t for _, t in cases]


def test_text_for_a_figure_is_generic(spark):
    one = rows(spark, {"FlowBytesPerSec": 500_001}, {}).withColumn("FlowBytesPerSec", F.when(F.col("flow_no") == 0, "much").otherwise("600000"))
    assert [r.t for r in one.orderBy("flow_no").select(net.attack_type().alias("t")).collect()] == [fv.GENERIC_ATTACK, "DDoS / Volumetric Flood"]


def test_ports_that_are_no_number(spark):
    flags = batches(spark, {"DestinationPort": NAN}, {"DestinationPort": 22}, {"DestinationPort": float("inf")}, p_attack=0.9).withColumn("attack_type", F.lit("x"))
    assert [(r.port, r.flows) for r in net.top_ports(flags).collect()] == [(22, 1)]
    assert net.network_alerts(batches(spark, *[{"p_attack": 0.7, "DestinationPort": NAN}] * 30)).first().event_count == 30


def test_dominant_type_counts_all(spark):
    """The type of the first 200 flows is not the type of most."""
    many = [{"p_attack": 0.9, "FlowStartTime": i / 100, **({"FlowPacketsPerSec": 2000} if i >= 210 else {})} for i in range(500)]
    assert net.dominant_types(net.flagged(batches(spark, *many))).first().attack_type == "UDP Flood"
    even = [{"p_attack": 0.9, "FlowStartTime": i / 100, **({"FlowPacketsPerSec": 2000} if i % 2 else {})} for i in range(10)]
    assert net.dominant_types(net.flagged(batches(spark, *even))).first().attack_type == "Port Scan"


def test_flows_without_a_start_take_the_ingest_time(spark):
    lost = rows(spark, *[{"p_attack": 0.7, "DestinationPort": 22}] * 2).withColumn("FlowStartTime", F.lit(None).cast("double"))
    early, late = (net.network_alerts(net.batch_of(lost, as_of=at)).collect() for at in (1000.0, 2000.0))
    assert {r.batch_start for r in early} == {990} and {r.batch_start for r in late} == {1980}
    assert {r.timestamp for r in early} == {"1970-01-01T00:16:40+00:00"}


def test_burst_limit(spark):
    many = batches(spark, *[{"p_attack": 0.65 + i / 1000, "DestinationPort": 22 + i % 2} for i in range(20)], *[{"p_attack": 0.6499}] * 3)
    assert net.flow_alerts(many).count() == 20 and net.burst_summaries(many).count() == 0
    more = batches(spark, *[{"p_attack": 0.7, "DestinationPort": 22 + i % 2} for i in range(21)])
    assert net.flow_alerts(more).count() == 0
    one = net.burst_alerts(more).first()
    assert one.event_count == 21 and one.severity == 1 and '"top_ports":{"22":11,"23":10}' in one.evidence


def test_batch_rule_limits(spark):
    scan = lambda flows, ports: batches(spark, *[{"DestinationPort": i % ports + 1, "TotalFwdPackets": 2} for i in range(flows)])
    assert net.batch_rule_hits(scan(49, 30)).count() == 0
    assert net.batch_rule_hits(scan(50, 29)).count() == 0
    assert net.batch_rule_hits(scan(50, 30)).select("flow_count", "port_count").first() == (50, 30)
    flood = lambda n, **more: batches(spark, *[{"DestinationPort": 9, "TotalFwdPackets": 3, "FlowBytesPerSec": 1, **more}] * n)
    assert net.batch_rule_hits(flood(49)).count() == 0
    assert net.batch_rule_hits(flood(50)).first().attack_type == "UDP Flood"
    assert net.batch_rule_hits(flood(50, DestinationPort=443)).count() == 0
    assert net.batch_rule_hits(flood(50, FlowBytesPerSec=NAN)).count() == 0


def test_scoring_rows(spark):
    raw = rows(spark, {"DestinationPort": 53, "FlowDurationMs": 1}, {"DestinationPort": 80}, {"DestinationPort": 80, "FINFlagCount": NAN},
                  {"DestinationPort": 80, "FINFlagCount": 1, "FlowBytesPerSec": float("inf")}).drop("PSHFlagCount", "p_attack")
    kept = net.scoring_rows(raw).collect()
    assert [r.flow_no for r in kept] == [3] and kept[0].FlowBytesPerSec == float("inf") and kept[0].PSHFlagCount is None
    assert kept[0].x[fv.MODEL_FEATURES.index("FlowBytesPerSec")] == 0 and len(kept[0].x) == 38


def test_model_checks(spark):
    width = len(fv.MODEL_FEATURES)
    good = net.Model([np.ones((width, 2)), np.ones((2, 1))], [np.zeros(2), np.zeros(1)], np.zeros(width), np.ones(width))
    scored = net.scored(net.scoring_rows(rows(spark, {"FINFlagCount": 1}).drop("p_attack")), good).first()
    assert scored.p_attack == pytest.approx(1 / (1 + np.exp(2)))
    with pytest.raises(ValueError, match="class order"):
        net.Model(good.coefs, good.intercepts, good.mean, good.scale, classes=(1, 0)).validated()
    with pytest.raises(ValueError, match="takes 37"):
        net.Model([np.ones((37, 1))], [np.zeros(1)], np.zeros(37), np.ones(37)).validated()
