"""Counting rules at their limits, and single-event rules on hand-made events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from nightwarden.operators.sliding import sliding_counts
from nightwarden.plans import host_detection
from nightwarden.schemas import HOST_EVENTS
from nightwarden.sources.indicators import default_indicators

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """Rows of (seconds, event id, data)."""
    return spark.createDataFrame([
        (i, "p", eid, str(eid), "0", "Security", "pc", START + dt.timedelta(seconds=at), data, f"<raw {i}>")
        for i, (at, eid, data) in enumerate(rows)], HOST_EVENTS)


def fired(spark, rows, rule=None):
    found = host_detection.threshold_detections(events(spark, rows), rule).collect()
    assert all(r.raw_xml == f"<raw {r.log_id}>" for r in found)
    return sorted((r.rule_id, r.log_id) for r in found)


def failure(at, user="bob", ip="10.0.0.5", **more):
    return at, 4625, {"IpAddress": ip, "TargetUserName": user, **more}


def test_brute_force_limits(spark):
    rule = "brute_force_logon"
    assert fired(spark, [failure(i) for i in range(9)], rule) == []
    assert fired(spark, [failure(i) for i in range(11)], rule) == [(rule, 9)]
    # The event exactly one window old still counts, one microsecond later it does not.
    assert fired(spark, [failure(0)] + [failure(60)] * 9, rule) == [(rule, 9)]
    assert fired(spark, [failure(0)] + [failure(60.000001)] * 9, rule) == []
    # After the first alert the next one needs a full window.
    burst = [failure(i) for i in range(10)] + [failure(68.999999)] * 12 + [failure(69)]
    assert fired(spark, burst, rule) == [(rule, 9), (rule, 22)]


def test_spray_limits(spark):
    rule = "password_spray"
    four = [failure(i, f"u{i}") for i in range(4)]
    assert fired(spark, four + [failure(5, ""), failure(6, "u0")], rule) == []
    assert fired(spark, four + [failure(5, "")] + [failure(6, "u9")], rule) == [(rule, 5)]
    # Local logons share one label, whatever way Windows writes them.
    local = [failure(i, f"u{i}", ip) for i, ip in enumerate(["-", "", "::1", " ", "127.0.0.1"])]
    assert fired(spark, local, rule) == [(rule, 4)]


def test_scan_limits(spark):
    rule = "net_portscan"
    hit = lambda at, port, **more: (at, 5156, {"SourceAddress": "10.1.1.1", "DestPort": port, **more})
    assert fired(spark, [hit(0, "1"), hit(1, "2"), hit(2, "2")], rule) == []
    assert fired(spark, [hit(0, "1"), hit(1, "2"), hit(2, "3", Direction="%%14592")], rule) == [(rule, 2)]
    assert fired(spark, [hit(0, "1"), hit(1, "2"), hit(2, "3", Direction="%%14593")], rule) == []
    assert fired(spark, [hit(0, "1"), hit(1, "2"), hit(2, "-")], rule) == []


def test_sliding_counts_match_replay(spark):
    rng, rows, at = random.Random(3), [], 0
    for i in range(1200):
        at += rng.choice([0, 1, 3, 11, 40 if rng.random() < 0.1 else 2])
        rows.append((rng.choice("aab"), at, i, rng.choice(["x", "y", "z", "", None])))
    df = spark.createDataFrame(rows, "k string, at long, no long, v string").repartition(4)
    got = {r.no: (r.window_total, r.window_distinct) for r in sliding_counts(
        df, ["k"], "at", "no", F.col("v"), window_us=20, chunk_us=25).collect()}
    for n, (k, now, i, _) in enumerate(rows):
        window = [v for kk, t, _, v in rows[:n + 1] if kk == k and t >= now - 20]
        assert got[i] == (len(window), len({v for v in window if v}))


def test_event_rules(spark):
    lists = default_indicators(spark)
    rows = [
        (0, 4769, {"TicketEncryptionType": " 0x17 ", "ServiceName": "sql"}), (1, 4769, {"TicketEncryptionType": "0x17", "ServiceName": "PC$"}),
        (2, 4768, {}), (3, 4768, {"PreAuthType": "0"}),
        (4, 4104, {"ScriptBlockText": "new-object x.y NET.WEBCLIENT"}), (5, 4104, {"ScriptBlockText": "x -enc\nabc"}),
        (6, 7045, {"ServiceName": "psexesvc", "ImagePath": "C:\\Temp\\a.exe"}), (7, 7045, {"ServiceName": "q", "ImagePath": "C:\\TEMP\\a.exe"}),
        (8, 4698, {"TaskContent": "", "TaskName": "run rundll32"}), (9, 4732, {"TargetUserName": "", "GroupName": "x Backup Operators"}),
        (10, 4688, {"NewProcessName": "C:\\w\\WMIC.exe", "CommandLine": "shadowcopy delete", "ParentProcessName": "c:/x/WinWord.exe"}),
        (11, 4688, {"NewProcessName": "C:\\w\\PowerShell.exe", "ParentProcessName": "c:/x/WinWord.exe"}),
        (12, 3008, {"QueryName": "A.ddns.NET.."}), (13, 3008, {"QueryName": "xddns.net"}), (14, 3008, {"QueryName": "sub.pastebin.com"}),
        (15, 5156, {"DestAddress": "185.220.101.34", "SourceAddress": "10.0.0.1"}), (16, 5156, {"DestAddress": "185.220.101.1"}),
        (17, 5156, {"DestAddress": "fe80::1"}), (18, 5012, {}), (19, 1102, {"subjectusername": "eve"}),
    ]
    found = {}
    for r in host_detection.detections(events(spark, rows), lists).collect():
        found.setdefault(r.log_id, set()).add(r.rule_id)
    assert found == {
        0: {"kerberoasting_rc4"}, 3: {"asrep_roasting"}, 4: {"ps_download_cradle"}, 5: {"ps_encoded_command"},
        6: {"psexec_lateral_movement"}, 7: {"new_service_suspicious_path"},
        8: {"scheduled_task_created", "scheduled_task_suspicious"}, 9: {"privileged_group_modification"},
        10: {"shadow_copy_deletion"}, 11: {"ioc_process_chain"}, 12: {"ioc_domain_match"},
        15: {"ioc_ip_connection"}, 16: {"ioc_ip_connection"}, 18: {"defender_disabled"}, 19: {"security_log_cleared"},
    }
    evidence = {r.log_id: r.evidence for r in host_detection.detections(events(spark, rows), lists).collect()}
    assert '"MatchedIOC":"185.220.101.34"' in evidence[15] and '"SrcAddress":"10.0.0.1"' in evidence[15]
    assert '"MatchedIOC":"185.220.101.0/24"' in evidence[16] and '"MatchedIOC":"*.ddns.net"' in evidence[12]
    assert '"SubjectUser":"eve"' in evidence[19]
