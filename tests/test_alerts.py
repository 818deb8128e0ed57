"""Alert store at its limits."""

import pytest
from pyspark.sql import functions as F

from nightwarden.plans import alert_store as store

SCHEMA = ("alert_id string, arrival long, received_at double, client_id string, client_ip string, track int, attack_type string, "
          "severity int, confidence double, event_count int, rule_id string, mitre_id string")


def alerts(spark, rows):
    base = {"client_id": "c", "client_ip": "1", "track": 1, "attack_type": "t", "severity": 2, "confidence": 0.5,
            "event_count": 1, "rule_id": "", "mitre_id": ""}
    data = []
    for i, (at, more) in enumerate(rows):
        r = {"alert_id": f"a{i}", "arrival": i, "received_at": float(at), **base, **more}
        data.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("chunk", [3600.0, 70.0])
def test_merge_limits(spark, chunk):
    merge = lambda rows: sorted(
        (r.alert_id, r.event_count, r.confidence, r.received_at, r.severity, r.rule_id, r.mitre_id)
        for r in store.merge_bursts(alerts(spark, rows), chunk_seconds=chunk).collect())
    # The gap itself merges, and merging goes on for longer than one gap in all.
    chain = [(0, {"event_count": 0, "severity": 4}), (60, {"event_count": 3, "confidence": 0.9, "rule_id": "r1"}),
             (120, {"rule_id": "r2", "mitre_id": "m"}), (180, {}), (240.001, {"confidence": 0.1})]
    assert merge(chain) == [("a0", 6, 0.9, 180.0, 4, "r1", "m"), ("a4", 1, 0.1, 240.001, 2, "", "")]
    assert len(merge([(0, {}), (1, {"track": 2}), (2, {"client_id": "d"}), (3, {"attack_type": "u"})])) == 4
    assert len(merge([(5, {}), (5, {}), (5, {})])) == 1


def test_resent_alert_counts_once(spark):
    (row,) = store.ingest(alerts(spark, [(0, {}), (10, {"alert_id": "a0", "event_count": 7}), (20, {})])).collect()
    assert row.event_count == 2 and row.received_at == 20.0


def test_alerts_without_an_id_are_all_kept(spark):
    sent = alerts(spark, [(0, {"alert_id": ""}), (0, {"alert_id": None, "client_id": "d"}), (1, {"alert_id": "", "attack_type": "u"}), (2, {}), (3, {"alert_id": "a9"})])
    kept = store.unique_alerts(sent).collect()
    assert len(kept) == 5 and len({r.alert_id for r in kept}) == 5 and all(r.alert_id for r in kept)
    assert {r.alert_id for r in kept} == {r.alert_id for r in store.unique_alerts(sent.repartition(3)).collect()}


def test_merge_into_store(spark):
    """A batch extends young rows whatever their status, repeats nothing, and leaves the rest alone."""
    sent = alerts(spark, [(0, {}), (10, {}), (500, {"client_id": "d"})])
    first = store.ingest(sent)
    late = [(60, {"alert_id": "b0", "rule_id": "r"}), (110, {"alert_id": "b1"}), (500, {"alert_id": "a2", "client_id": "d"}), (700, {"alert_id": "b3", "client_id": "d"}),
            (20, {"alert_id": "a1"})]
    changed = {r.alert_id: (r.event_count, r.received_at, r.rule_id) for r in store.merge_into_store(first, alerts(spark, late), sent).collect()}
    assert changed == {"a0": (4, 110.0, "r"), "b3": (1, 700.0, "")}
    closed = first.withColumn("status", F.lit("resolved"))
    (grown,) = store.merge_into_store(closed, alerts(spark, late[:1]), sent).collect()
    assert (grown.alert_id, grown.event_count, grown.status) == ("a0", 3, "resolved")
    assert store.merge_into_store(first, alerts(spark, late).filter("false"), sent).count() == 0


def test_status_and_search(spark):
    rows = alerts(spark, [(i, {"client_id": c}) for i, c in enumerate(["PC-1", "pc-2", "other"])])
    changes = spark.createDataFrame(
        [("a0", "resolved", 1.0, 0), ("a0", "open", 2.0, 1), ("a1", " false_positive ", 1.0, 2), ("a1", "closed", 9.0, 3)],
        "alert_id string, status string, changed_at double, arrival long")
    now = {r.alert_id: r.status for r in store.current_status(rows, changes).collect()}
    assert now == {"a0": "open", "a1": "false_positive", "a2": "open"}
    assert store.search(rows, client_id="pc_").count() == 2 and store.search(rows).count() == 3
    assert [r.alert_id for r in store.page(rows, 1, 1).collect()] == ["a1"]


def test_empty_store_has_zero_counts(spark):
    none = alerts(spark, [(0, {})]).filter("false")
    assert {r.severity: r.alerts for r in store.by_severity(none).collect()} == dict.fromkeys(range(5), 0)
    assert {r.track: r.alerts for r in store.by_track(none).collect()} == dict.fromkeys(range(3), 0)


def test_liveness_limit(spark):
    beats = spark.createDataFrame([("a", 821.0, 1), ("b", 820.0, 2), ("a", 10.0, 3)], "client_id string, last_seen double, beat long")
    got = [(r.client_id, r.online, r.last_seen_ago) for r in store.liveness(store.latest_heartbeats(beats), 1000.0).collect()]
    assert got == [("a", True, 179), ("b", False, 180)]


def test_flatten(spark):
    batch = spark.range(2).select(F.col("id").alias("batch"), F.array(F.struct(F.lit("x").alias("alert_id")), F.struct(F.lit("y").alias("alert_id"))).alias("alerts"))
    assert store.flatten_batches(batch).count() == 4


def test_ids_of_the_whole_store(spark, tmp_path):
    """Replayed batches agree, resends of other days are found, a merged day answers as its batches do."""
    import datetime as dt

    from nightwarden.streaming import alert_ids

    day = 86_400
    sent = [(f"a{i}", float(i * 3600), "c", i) for i in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, "alert_id string, received_at double, client_id string, arrival long").withColumns(
        {"track": F.lit(1), "attack_type": F.lit("t")})
    ids = alert_ids.AlertIds(spark, str(tmp_path), blocks=64)
    run = alert_ids.first_arrivals(ids)
    new = lambda rows, n: sorted(r.alert_id for r in run(frame(rows), n).collect())
    assert new(sent[:60], 0) == sorted(r[0] for r in sent[:60])
    late = sent[50:] + [("a3", 9.0 * day, "c", 200), ("b", 9.0 * day, "c", 201), ("b", 9.0 * day, "c", 202)]
    expected = sorted([r[0] for r in sent[60:]] + ["b"])
    assert new(late, 1) == expected and new(late, 1) == expected
    ids.merge_day(dt.date(1970, 1, 1))
    ids.merge_day(dt.date(1970, 1, 1))
    assert new(late, 2) == [] and new([("c", 1.0, "c", 300)], 3) == ["c"]


def test_indexed_search_and_pages(spark, tmp_path):
    from nightwarden.plans import alert_search

    rows = [(f"a{i:03}", float(i % 7 * 86_400 + i % 3), ["PC-1", "pc-22", "Ünit", None][i % 4], ["", "net_scan", None][i % 3], ["Port Scan", "x%y_z", "ab"][i % 3], i % 3, i % 5)
            for i in range(120)]
    df = spark.createDataFrame(rows, "alert_id string, received_at double, client_id string, rule_id string, attack_type string, track int, severity int")
    path = str(tmp_path / "s")
    alert_search.write_store(df, path)
    alert_search.write_store(df, path)
    ids = lambda found: sorted(r.alert_id for r in found.collect())
    for kw in ({"rule_id": "SCAN"}, {"rule_id": "p"}, {"rule_id": "x%y"}, {"rule_id": "ort_sc"}, {"client_id": "ÜNI"}, {"client_id": "nobody"},
               {"rule_id": "scan", "client_id": "pc", "track": 1, "min_severity": 2}, {}):
        assert ids(alert_search.search(spark, path, **kw)) == ids(store.search(df, **kw)), kw
    plan = alert_search.search(spark, path, rule_id="scan")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [received_day" in plan
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    got, after = [], None
    while True:
        page = [tuple(r) for r in alert_search.page_after(spark, path, after, 25).select(*df.columns).collect()]
        got += page
        if not page:
            break
        after = (page[-1][1], page[-1][0])
    assert got == want
    last = alert_search.page_after(spark, path, None, 5)._jdf.queryExecution().toString()
    assert last.count("received_day") >= 1
    only = alert_search.page_after(spark, path, None, 50, F.col("severity") == 4)
    assert [r.alert_id for r in only.collect()] == [r[0] for r in want if r[6] == 4]
    alert_search.write_store(df.limit(0), str(tmp_path / "e"))


def test_filter_of_a_crowded_day_grows(spark, tmp_path):
    from nightwarden.streaming import alert_ids

    ids = alert_ids.AlertIds(spark, str(tmp_path), blocks=64)
    sent = lambda first, n: spark.range(first, first + n).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("alert_id"), F.lit(1_704_100_000.0).alias("received_at"))
    ids.record(sent(0, 5000), 0)
    ids.record(sent(5000, 10), 1)
    filters = spark.read.schema(alert_ids.FILTERS).parquet(f"{tmp_path}/filters")
    assert {(r.batch_id, r.blocks) for r in filters.select("batch_id", "blocks").distinct().collect()} == {(0, 512), (1, 64)}
    assert {r.alert_id for r in ids.known(sent(4998, 20), 2).collect()} == {f"a{i}" for i in range(4998, 5010)}
