"""Stream and batch forms agree on the same input."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from checks import network, views
from nightwarden.plans import alert_store, flows, host_detection, network_detection
from nightwarden.sources.indicators import default_indicators
from nightwarden.streaming import alert_stream, flow_stream, host_stream, waiting


def replay(spark, df, order, tmp_path, parts=3, end=None):
    """Write the rows as ordered files and read them back one file per micro-batch."""
    source = str(tmp_path / "in")
    n = df.count()
    part = F.least(F.floor(F.col(order) * parts / F.lit(n)), F.lit(parts - 1))
    for i in range(parts):
        df.filter(part == i).coalesce(1).write.mode("append").parquet(source)
    if end is not None:
        end.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)


def finish(stream, spark, tmp_path, name):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def test_threshold_rules(spark, sf_dir, tmp_path):
    events = views.host_events(spark, sf_dir).filter("event_id in (4625, 5156, 5157)").cache()
    far = events.orderBy(F.desc("log_id")).limit(1).withColumn("event_time", F.lit(dt.datetime(2030, 1, 1))).withColumn(
        "computer", F.lit("end"))
    stream = replay(spark, events, "log_id", tmp_path, end=far)
    got = {(r.rule, r.log_id) for r in finish(host_stream.threshold_fires(stream), spark, tmp_path, "fires").collect()}
    expected = {(r.rule_id, r.log_id) for r in host_detection.threshold_detections(events).collect()}
    assert expected and got == expected


def test_flows(spark, sf_dir, tmp_path):
    packets = views.packets(spark, sf_dir).cache()
    far = packets.orderBy(F.desc("seq")).limit(1).withColumns({
        "ts_us": F.col("ts_us") + 10**12, "src_ip": F.lit("9.9.9.9"), "client_id": F.lit("end")})
    stream = replay(spark, packets, "seq", tmp_path, parts=2, end=far)
    done = finish(flow_stream.finished_flows(stream), spark, tmp_path, "flows")
    columns = ["anchor_order", "Src IP", "Tot Fwd Pkts", "Tot Bwd Pkts", "Flow Duration", "Idle Max"]
    got = sorted(tuple(r) for r in flows.state_features(done).select(*columns).collect())
    batch = flows.flow_features(flows.assign_flows(flows.ip_packets(packets), flush_idle=True)).select(*columns)
    assert got and got == sorted(tuple(r) for r in batch.collect())


def test_burst_merge(spark, sf_dir, tmp_path):
    alerts = views.alerts(spark, sf_dir).cache()
    assert dict(alerts.dtypes)["received_at"] == "double"
    far = alerts.orderBy(F.desc("arrival")).limit(1).withColumns({
        "received_at": F.col("received_at") + 1e6, "alert_id": F.lit("end"), "client_id": F.lit("end")})
    stream = replay(spark, alerts, "arrival", tmp_path, parts=2, end=far)
    key = ["client_id", "attack_type", "track", "alert_id", "event_count", "rule_id", "mitre_id", "received_at"]
    got = sorted(tuple(r) for r in finish(alert_stream.merged_bursts(stream), spark, tmp_path, "bursts").select(*key).collect())
    assert got and got == sorted(tuple(r) for r in alert_store.ingest(alerts).select(*key).collect())


def test_the_first_sent_of_an_id_is_kept_in_any_order(spark, sf_dir, tmp_path):
    """An id sent twice in one batch, the later alert read first; its type names it."""
    one = views.alerts(spark, sf_dir).limit(1).drop("alert_id", "arrival", "attack_type")
    i = F.col("id")
    sent = spark.range(400).select(
        F.concat(F.lit("a"), (i / 2).cast("int").cast("string")).alias("alert_id"), i.alias("arrival"),
        F.when(i % 2 == 0, "first").otherwise("second").alias("attack_type"), (1_704_100_000.0 + i).alias("at")).crossJoin(one)
    sent = sent.withColumn("received_at", F.col("at")).drop("at").coalesce(1).sortWithinPartitions(F.desc("arrival"))
    end = sent.limit(1).withColumns({"alert_id": F.lit("end"), "received_at": F.lit(1_804_100_000.0)})
    stream = replay(spark, sent, "arrival", tmp_path, parts=1, end=end)
    got = finish(alert_stream.merged_bursts(stream), spark, tmp_path, "bursts").collect()
    assert {(r.attack_type, r.alert_id) for r in got} == {("first", "a0")}


def test_lists_are_read_anew_per_batch(spark, sf_dir, tmp_path):
    events = views.host_events(spark, sf_dir).filter("event_id = 3008")
    reads = []

    def lists():
        reads.append(1)
        return default_indicators(spark)

    stream = replay(spark, events, "log_id", tmp_path, parts=2)
    query = host_stream.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck"),
                                      host_stream.batch_detections(lists), trigger={"availableNow": True})
    query.awaitTermination(240)
    assert query.exception() is None and len(reads) == 2
    got = spark.read.parquet(str(tmp_path / "out")).count()
    assert got == host_detection.indicator_detections(events, default_indicators(spark), "ioc_domain_match").count()


def test_packets_to_network_alerts(spark, sf_dir, tmp_path):
    packets = views.packets(spark, sf_dir)
    last = packets.orderBy(F.desc("seq")).limit(1).withColumns({
        "ts_us": F.col("ts_us") + 10**12, "src_ip": F.lit("9.9.9.9"), "client_id": F.lit("end")})
    done = flow_stream.finished_flows(replay(spark, packets, "seq", tmp_path, parts=1, end=last))
    query = host_stream.write_batches(
        done, str(tmp_path / "out"), str(tmp_path / "ck"), network_detection.network_alerts,
        flow_stream.scored_rows(network.model()), {"availableNow": True})
    query.awaitTermination(240)
    assert query.exception() is None
    got = {r.alert_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    features = flows.packet_features(flows.ip_packets(packets), flush_idle=True)
    rows = flows.model_rows(features, "client_id", F.col("anchor_order").alias("flow_no"))
    rows = network_detection.scored(network_detection.scoring_rows(rows), network.model())
    assert got == {r.alert_id for r in network_detection.network_alerts(rows).collect()}


def updates_per_run(spark, parts, build, tmp_path):
    """State rows that each run writes when the parts arrive one after the other."""
    folder, updated = str(tmp_path / "in"), []
    parts[0].limit(0).write.parquet(folder)
    stream = build(spark.readStream.schema(parts[0].schema).parquet(folder))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        query.awaitTermination(240)
        updated.append(sum(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators))
    return updated


def test_a_trigger_does_not_rewrite_the_open_window(spark, sf_dir, tmp_path):
    one = views.host_events(spark, sf_dir).filter("event_id = 4625").limit(1)
    data = F.map_concat(F.map_filter("data", lambda k, _: ~k.isin("IpAddress", "TargetUserName")),
                        F.create_map(F.lit("IpAddress"), F.lit("1.1.1.1"), F.lit("TargetUserName"), F.concat(F.lit("u"), F.col("i").cast("string"))))

    def events(first, n, gap_ms):
        ids = spark.range(first, first + n).withColumnRenamed("id", "i")
        return ids.crossJoin(one).withColumns({
            "log_id": F.col("i"), "data": data, "event_time": F.timestamp_millis(F.lit(1_704_100_000_000) + F.col("i") * gap_ms)}).drop("i")

    # 20,000 events in a second; then five at a time, 2.5 s apart, in the same window.
    parts = [events(0, 20_000, 0)] + [events(k * 5, 5, 500).withColumn("log_id", F.col("log_id") + 100_000) for k in range(4, 20)]
    updated = updates_per_run(spark, parts, lambda s: host_stream.threshold_fires(s, delay="0 seconds"), tmp_path)
    assert max(updated[1:]) > 15_000 and sorted(updated[1:])[-2] < 200


def test_an_open_flow_costs_the_same_with_many_packets(spark, sf_dir, tmp_path):
    one = views.packets(spark, sf_dir).limit(1).withColumns({"flag_fin": F.lit(False), "flag_rst": F.lit(False)})

    def packets(first, n, gap_us):
        ids = spark.range(first, first + n).withColumnRenamed("id", "i")
        return ids.crossJoin(one).withColumns({"seq": F.col("i"), "ts_us": F.lit(1_704_100_000_000_000) + F.col("i") * gap_us}).drop("i")

    parts = [packets(0, 20_000, 10)] + [packets(k, 1, 1_000_000).withColumn("seq", F.col("seq") + 100_000) for k in range(1, 14)]
    parts.append(packets(100, 1, 1_000_000))
    updated = updates_per_run(spark, parts, lambda s: flow_stream.finished_flows(s, delay="0 seconds"), tmp_path)
    assert max(updated) < 50
    (flow,) = flows.state_features(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert flow["Tot Fwd Pkts"] + flow["Tot Bwd Pkts"] == 20_013


def test_rows_that_come_together_wait_together(spark, sf_dir, tmp_path):
    """2,000 packets in 2,000 slices are a few entries of the state."""
    one = views.packets(spark, sf_dir).limit(1)
    ids = spark.range(2000)
    sent = ids.crossJoin(one).withColumns({"seq": F.col("id"), "ts_us": F.lit(1_704_100_000_000_000) + F.col("id") * 6_000_000}).drop("id")
    assert max(updates_per_run(spark, [sent], lambda s: flow_stream.finished_flows(s, delay="0 seconds"), tmp_path)) < 50


class Held(dict):
    """A value or map state, and the handle that gives it, in memory."""

    value = None
    exists = lambda self: self.value is not None
    updateValue = dict.__setitem__
    getValue, removeKey = dict.get, dict.pop
    getMapState = getValueState = lambda self, *_: Held()
    registerTimer = lambda self, _: None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_waiting_rows_are_bytes_in_the_state():
    columns = {"at_us": "bigint", "value": "string"}
    waits = waiting.Waiting(Held(), columns, "at_us", 10)
    n = waiting.ENTRY_ROWS + 5
    waits.add([pd.DataFrame({"at_us": range(n), "value": [None if i % 3 else f"v{i}" for i in range(n)]})])
    assert len(waits.entries) == 2 and all(isinstance(v, bytes) for (v,) in waits.entries.values())
    early, rest = waits.passed(1), waits.passed(n)
    assert early["at_us"].tolist() + rest["at_us"].tolist() == list(range(n)) and len(early) == 1000
    assert rest["value"].tolist()[:3] == [None, None, "v1002"] and not waits.entries
