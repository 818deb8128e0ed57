"""Flow assembly and features on small captures with known answers."""

import math
import random
import statistics

import pytest

from nightwarden import fixed_values as fv
from nightwarden.plans import flows
from nightwarden.schemas import PACKETS

BASE = 1_494_000_000_000_000


def packet(seq, src, dst, sport, dport, at, payload, header=20, window=0, proto=6, flags=(), client="c"):
    on = {f: f in flags for f in flows.FLAGS}
    return (client, seq, src, dst, sport, dport, proto, BASE + at, payload, header, window, *on.values())


def features(spark, rows, **kw):
    df = spark.createDataFrame(rows, PACKETS)
    return [r.asDict() for r in flows.packet_features(flows.ip_packets(df), **kw).collect()]


def test_three_packets_give_one_flow_of_84_columns(spark):
    a, b = "192.168.1.10", "10.0.0.1"
    rows = [
        packet(1, a, b, 54321, 80, 0, 100, window=65535, flags=("syn",)),
        packet(2, b, a, 80, 54321, 500_000, 200, window=8192, flags=("ack",)),
        packet(3, a, b, 54321, 80, 1_000_000, 0, flags=("fin", "ack")),
    ]
    (flow,) = features(spark, rows)
    assert len(fv.FLOW_COLUMNS) == 84 and all(name in flow for name in fv.FLOW_COLUMNS)
    # 192 read as a signed byte is below 10.
    assert flow["Flow ID"] == "192.168.1.10-10.0.0.1-54321-80-6"
    assert (flow["Src IP"], flow["Tot Fwd Pkts"], flow["Tot Bwd Pkts"]) == (a, 2, 1)
    assert flow["Flow Duration"] == 1_000_000 and flow["Flow Byts/s"] == 300
    assert flow["Pkt Len Mean"] == 100 and flow["Pkt Size Avg"] == pytest.approx(400 / 3)
    assert flow["Pkt Len Var"] == pytest.approx(statistics.variance([100, 100, 200, 0]))
    assert math.isnan(flow["Bwd Pkt Len Std"]) and flow["Bwd IAT Mean"] == 0
    assert math.isnan(flow["Fwd IAT Std"]) and flow["Fwd IAT Mean"] == 1_000_000
    assert (flow["Init Fwd Win Byts"], flow["Init Bwd Win Byts"]) == (65535, 8192)


def test_down_up_ratio_is_whole(spark):
    a, b = "192.168.1.1", "10.0.0.1"
    rows = [packet(1, a, b, 1000, 80, 0, 100)] + [
        packet(i, b, a, 80, 1000, i * 100_000, 50, flags=("fin",) if i == 4 else ()) for i in (2, 3, 4)]
    (flow,) = features(spark, rows)
    assert flow["Down/Up Ratio"] == 3.0
    rows.insert(1, packet(9, a, b, 1000, 80, 50_000, 10))
    (flow,) = features(spark, rows)
    assert flow["Down/Up Ratio"] == 1.0


def test_boundaries(spark):
    a, b, s = "1.1.1.1", "2.2.2.2", 1_000_000
    at = lambda *times: [packet(i, a, b, 1, 2, t, 5) for i, t in enumerate(times)]
    # Exactly the timeout still belongs to the flow, one microsecond more does not.
    assert [f["Tot Fwd Pkts"] for f in features(spark, at(0, 15 * s))] == [2]
    assert features(spark, at(0, 15 * s + 1)) == []
    # FIN after the timeout opens a flow and does not close it.
    late = at(0, s) + [packet(8, a, b, 1, 2, 20 * s, 5, flags=("fin",)), packet(9, a, b, 1, 2, 21 * s, 5)]
    assert sorted(f["FIN Flag Cnt"] for f in features(spark, late)) == [0, 1]
    # Zero duration.
    (flow,) = features(spark, at(7, 7))
    assert flow["Flow Byts/s"] == math.inf and flow["Fwd Pkts/s"] == 0
    # A flow that starts by timeout keeps its endpoints even when the other side speaks first.
    turned = at(0, s) + [packet(5, b, a, 2, 1, 40 * s, 1), packet(6, b, a, 2, 1, 41 * s, 1)]
    assert {f["Src IP"] for f in features(spark, turned)} == {a}
    assert {f["Src IP"] for f in features(spark, turned, flush_idle=True)} == {a, b}
    closed = at(0) + [packet(4, a, b, 1, 2, s, 5, flags=("rst",))] + turned[2:]
    assert {f["Src IP"] for f in features(spark, closed)} == {a, b}
    # Same address on both sides: everything is forward.
    (flow,) = features(spark, [packet(1, a, a, 1, 2, 0, 5), packet(2, a, a, 2, 1, 9, 5)])
    assert (flow["Tot Fwd Pkts"], flow["Tot Bwd Pkts"]) == (2, 0)


def brute_force(rows, bidirectional):
    """Flow by flow replay of the features that depend on packet order."""
    open_, done = {}, []
    names = [column.split()[0] for column in PACKETS.split(", ")]
    for row in sorted(rows, key=lambda r: (r[7], r[1])):
        p = dict(zip(names, row))
        key = frozenset([(p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])])
        flow = open_.get(key)
        if flow and p["ts_us"] - flow["packets"][0]["ts_us"] <= fv.FLOW_TIMEOUT_US:
            flow["packets"].append(p)
            if p["flag_fin"] or p["flag_rst"]:
                done.append(open_.pop(key))
        else:
            if flow:
                done.append(flow)
            open_[key] = {"src": flow["src"] if flow else p["src_ip"], "packets": [p]}
    out = []
    for flow in done + list(open_.values()):
        ps = flow["packets"]
        fwd = [p["src_ip"] == flow["src"] or (not bidirectional and i > 0) for i, p in enumerate(ps)]
        if (len(ps) if bidirectional else sum(fwd)) < 2:
            continue
        active, idle, start, end, last = [], [], 0, 0, ps[0]["ts_us"]
        runs, run = [], []
        for p in ps:
            gap, last = p["ts_us"] - last, p["ts_us"]
            if gap - end > fv.ACTIVITY_TIMEOUT_US:
                active += [end - start] if end > start else []
                idle.append(gap - end)
                start = gap
            end = gap
            if p["payload_bytes"] > 0:
                if run and p["ts_us"] - run[-1]["ts_us"] > 1_000_000:
                    runs.append(run)
                    run = []
                run.append(p)
        runs = [r for r in runs + [run] if len(r) >= 4]
        took = sum(r[-1]["ts_us"] - r[0]["ts_us"] for r in runs)
        out.append((
            ps[0]["ts_us"], flow["src"], sum(fwd), len(ps) - sum(fwd),
            round(statistics.mean(active), 3) if active else 0, max(idle, default=0),
            sum(map(len, runs)) // len(runs) if runs else 0,
            int(sum(p["payload_bytes"] for r in runs for p in r) / (took / 1e6)) if took else 0,
        ))
    return sorted(out)


@pytest.mark.parametrize("bidirectional", [True, False])
def test_matches_replay(spark, bidirectional):
    rng, rows, now = random.Random(5), [], 0
    pairs = [("1.1.1.1", "2.2.2.2", 5, 6), ("9.9.9.9", "8.8.8.8", 7, 8), ("200.1.1.1", "10.0.0.9", 70, 80)]
    for seq in range(900):
        now += rng.choice([200, 1000, 300_000, 900_000, 1_200_000, 7_000_000 if rng.random() < 0.1 else 10])
        src, dst, sport, dport = pairs[0] if rng.random() < 0.5 else rng.choice(pairs)
        if rng.random() < 0.4:
            src, dst, sport, dport = dst, src, dport, sport
        flag = rng.choice(["fin", "rst"]) if rng.random() < 0.02 else None
        rows.append(packet(seq, src, dst, sport, dport, now, rng.choice([0, 10, 500]), flags=(flag,)))
    got = sorted(
        (f["start_us"], f["Src IP"], f["Tot Fwd Pkts"], f["Tot Bwd Pkts"], round(f["Active Mean"], 3),
         f["Idle Max"], f["Bwd Pkts/b Avg"], f["Bwd Blk Rate Avg"])
        for f in features(spark, rows, bidirectional=bidirectional, chunk_us=16_000_000))
    assert got == brute_force(rows, bidirectional)


def test_states_do_not_depend_on_slices(spark):
    """One conversation in slices of three rows and chunks of a flow's length, against one slice."""
    rng, rows, now = random.Random(11), [], 0
    for seq in range(600):
        now += rng.choice([50, 900, 400_000, 1_100_000, 5_200_000 if rng.random() < 0.3 else 30])
        src, dst, sport, dport = ("1.1.1.1", "2.2.2.2", 5, 6) if rng.random() < 0.6 else ("2.2.2.2", "1.1.1.1", 6, 5)
        rows.append(packet(seq, src, dst, sport, dport, now, rng.choice([0, 0, 10, 700]), header=rng.choice([20, 32]),
                           window=rng.randrange(9), flags=(rng.choice(flows.FLAGS), "rst" if rng.random() < 0.01 else "ack")))
    shown = lambda fs: sorted(repr([round(v, 3) if isinstance(v, float) else v for v in f.values()]) for f in fs)
    for bidirectional in (True, False):
        whole = shown(features(spark, rows, bidirectional=bidirectional))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        try:
            assert whole and shown(features(spark, rows, bidirectional=bidirectional, chunk_us=15_000_002)) == whole
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_means_are_exact(spark):
    """Sums of whole numbers over their count, however the packets were folded."""
    rng, rows, expected = random.Random(3), [], {}
    for flow in range(40):
        at, times, payloads = 0, [], []
        for i in range(33):
            at += rng.randrange(1, 400_000) if i else 0
            times.append(at)
            payloads.append(rng.randrange(1500))
            rows.append(packet(flow * 100 + i, f"1.1.1.{flow}", "2.2.2.2", 1, 2, at, payloads[-1]))
        expected[f"1.1.1.{flow}"] = (times[-1] / 32, sum(payloads) / 33)
    assert {f["Src IP"]: (f["Flow IAT Mean"], f["Fwd Pkt Len Mean"]) for f in features(spark, rows)} == expected
