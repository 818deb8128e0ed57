"""Readers and writers."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import network, views
from nightwarden import fixed_values as fv
from nightwarden.plans import flows, learning
from nightwarden.sources import event_xml, flow_files, flow_tail, indicators, models

XML = ("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='P'/>"
       "<EventID>{id}</EventID><Level>4</Level><Channel>Security</Channel><Computer> pc </Computer>"
       "<TimeCreated SystemTime='2024-01-01T00:00:00.5000000Z'/></System>{body}</Event>")


def test_event_xml_cases(spark):
    rows = [
        (1, XML.format(id="4625", body="<EventData><Data Name='User'> a </Data><Data>x</Data><Data Name='User'>b</Data></EventData>")),
        (2, XML.format(id="oops", body="<EventData/>")),
        (3, "<Event><System>"),
        (4, XML.format(id="5861", body="<UserData><n:Op xmlns:n='urn:q'><n:Namespace>root</n:Namespace><n:Name>x</n:Name></n:Op></UserData>")),
        (5, "no xml at all"),
        (6, XML.format(id="1", body="<EventData><Data Name='Name'>mine</Data></EventData><UserData><Name>theirs</Name></UserData>")),
    ]
    got = {r.log_id: r for r in event_xml.parse_events(spark.createDataFrame(rows, "log_id long, raw_xml string")).collect()}
    assert sorted(got) == [1, 2, 4, 6]
    assert got[1].data == {"User": "b", "user": "b", "data_1": "x"} and got[1].event_id == 4625
    assert got[1].computer == "pc" and got[1].event_time == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert got[2].event_id is None and got[2].event_code == "oops" and got[2].data == {}
    assert got[4].data["Namespace"] == "root" and got[4].data["namespace"] == "root"
    assert got[6].data["Name"] == "mine"


def test_all_user_data_and_the_display_form(spark):
    body = ("<EventData><Data Name='param1'>v</Data><Data Name='Up'>w</Data></EventData><UserData><l:Log xmlns:l='urn:l'><l:SubjectUserName>eve</l:SubjectUserName>"
            "<l:SubjectDomainName x='1'>dom</l:SubjectDomainName><PossibleCause>a &amp;&lt; b</PossibleCause><Deep><Inner>1</Inner><Inner>2</Inner></Deep></l:Log></UserData>")
    raw = spark.createDataFrame([(1, XML.format(id="1102", body=body))], "log_id long, raw_xml string")
    data = event_xml.parse_events(raw).first().data
    assert {k: v for k, v in data.items() if k[0].isupper()} == {
        "Up": "w", "SubjectUserName": "eve", "SubjectDomainName": "dom", "PossibleCause": "a &< b", "Inner": "1"}
    assert json.loads(event_xml.nested_view(raw).first().data_json) == {"param1": "v", "Up": "w"}


def test_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("DestinationPort,FlowStartTime,note\n443,3.0,\"x, y\"\n")
    (tmp_path / "in" / "b.csv").write_text("FlowStartTime, DestinationPort\n4.5,80\nFlowStartTime, DestinationPort\n5.5,oops\n")
    rows = flow_files.read_model_csv(spark, str(tmp_path / "in"))
    want = [(443.0, 3.0), (80.0, 4.5), (None, 5.5)]
    assert sorted(((r.DestinationPort, r.FlowStartTime) for r in rows.collect()), key=lambda p: p[1]) == want
    assert {r.note for r in rows.collect()} == {"x, y", None}
    query = (flow_files.stream_model_csv(spark, str(tmp_path / "in"), files_per_trigger=1).writeStream.format("parquet")
             .option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.DestinationPort, r.FlowStartTime) for r in back), key=lambda p: p[1]) == want


def test_a_large_file_is_read_in_pieces(spark, tmp_path):
    """A stream reads a file by many tasks, each split by the header at its start; a whole file in one row does not fit."""
    (tmp_path / "in dir").mkdir()
    row = "{0}.5,  {1} ,more\r\n"
    (tmp_path / "in dir" / "a b.csv").write_bytes(("\ufeffFlowStartTime, DestinationPort,note\r\n" + "".join(row.format(i, i % 7) for i in range(5000))).encode())
    (tmp_path / "in dir" / "c.csv").write_text("DestinationPort,FlowStartTime\n9,7000.5\n\nDestinationPort,FlowStartTime\n8,7001.5")
    (tmp_path / "in dir" / "empty.csv").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        query = (flow_files.stream_model_csv(spark, str(tmp_path / "in dir")).writeStream.format("parquet")
                 .option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
        query.awaitTermination(120)
        batch = flow_files.read_model_csv(spark, str(tmp_path / "in dir"))
        got = [sorted((r.FlowStartTime, r.DestinationPort) for r in rows.collect()) for rows in (spark.read.parquet(str(tmp_path / "out")), batch)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1] == [*[(i + 0.5, i % 7) for i in range(5000)], (7000.5, 9.0), (7001.5, 8.0)]
    assert len(list((tmp_path / "out").glob("part-*"))) > 4


def test_lines_of_flow_files_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DestinationPort,FlowStartTime\n443,3.0\n")
    (tmp_path / "b.csv").write_text("FlowStartTime,DestinationPort\n4.0,80\n")
    rows = flow_files.read_model_csv(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted((r.DestinationPort, r.FlowStartTime) for r in rows.collect()) == [(80.0, 4.0), (443.0, 3.0)]
        assert "hashpartitioning(file" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_truth_logs_of_a_folder(spark, tmp_path):
    for client, base in (("c1", 1), ("c2", 50)):
        (tmp_path / client).mkdir()
        (tmp_path / client / "log.csv").write_text(f"unix_us,event,attack_type,detail\n{base}000000,PHASE_START,a,x\n{base + 1}000000,PHASE_END,a,x\n")
    (tmp_path / "c2" / "more.csv").write_text("unix_us,event,attack_type,detail\n70000000,PHASE_END,a,x\n80000000,PHASE_START,a,x\n")
    windows = learning.truth_windows(flow_files.read_truth_logs(spark, str(tmp_path / "*"))).collect()
    assert sorted((r.client_id, r.window_start, r.window_end) for r in windows) == [("c1", 1.0, 2.0), ("c2", 50.0, 51.0)]


def test_list_files_and_reload(spark, tmp_path):
    (tmp_path / "ioc_domains.txt").write_text("# head\n*.Evil.net # why\nbad.org\n\n  *.evil.net\n")
    (tmp_path / "ioc_ips.txt").write_text("10.1.2.3/8\n300.1.1.1\n9.9.9.9\n9.9.9.9\n::1\n1.2.3.4/33\n10.0.0.9/255.255.0.0\n")
    (tmp_path / "ioc_process_chains.txt").write_text("A.exe -> b.exe first\na.exe->B.EXE # cut\n")
    lists = indicators.read_indicators(spark, str(tmp_path))
    assert {tuple(r) for r in lists.domains.collect()} == {("evil.net", True), ("bad.org", False)}
    assert {(r.label, r.lo, r.hi) for r in lists.addresses.collect()} == {
        ("10.0.0.0/8", 10 << 24, (11 << 24) - 1), ("9.9.9.9", 0x09090909, 0x09090909), ("::1", None, None),
        ("10.0.0.0/16", 10 << 24, (10 << 24) + 65535)}
    assert lists.process_names.count() == 0
    assert [tuple(r) for r in lists.process_chains.collect()] == [("a.exe", "b.exe", "a.exe spawning b.exe")]
    (tmp_path / "ioc_domains.txt").write_text("new.org\n")
    assert {r.entry for r in indicators.read_indicators(spark, str(tmp_path)).domains.collect()} == {"new.org"}
    assert {r.list: r.entries for r in indicators.default_indicators(spark).sizes().collect()} == {
        "domains": 56, "ip_ranges": 32, "process_names": 74, "process_chains": 77}


def test_flow_files(spark, sf_dir, tmp_path):
    flows84 = flows.flow_features(flows.assign_flows(views.packets(spark, sf_dir)))
    flow_files.write_flows84(flows84, str(tmp_path / "f84"))
    back = spark.read.option("header", True).csv(str(tmp_path / "f84"))
    assert tuple(back.columns) == fv.FLOW_COLUMNS and back.count() == flows84.count()

    rows = views.flows(spark, sf_dir).filter("FlowStartTime is not null").withColumn(
        "FlowStartTime", F.col("FlowStartTime") + F.col("flow_no") % 12 * 86400)
    flow_files.write_model_rows(rows, str(tmp_path / "days"))
    today = dt.date(2024, 1, 12)
    current = flow_files.archive_old(spark, str(tmp_path / "days"), str(tmp_path / "old"), today)
    flow_files.archive_old(spark, str(tmp_path / "days"), str(tmp_path / "old"), today)
    archived = spark.read.parquet(str(tmp_path / "old"))
    assert archived.count() + current.count() == rows.count() and archived.count() > 0
    assert archived.agg(F.max("flow_date")).first()[0] == dt.date(2024, 1, 4)
    one_day = flow_files.read_days(spark, str(tmp_path / "days"), today, today)
    assert "PartitionFilters: [isnotnull(flow_date" in one_day._jdf.queryExecution().toString()


def test_day_folders_are_written_without_a_sort(spark, sf_dir, tmp_path):
    """A sort of wide rows by day spills all of them where a task reads more than its memory holds."""
    rows = views.flows(spark, sf_dir).filter("FlowStartTime is not null").withColumn(
        "FlowStartTime", F.col("FlowStartTime") + F.col("flow_no") % 12 * 86400)
    ran = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: {e.executionId(): e for e in map(ran.executionsList().apply, range(ran.executionsList().size()))}
    last = max(listed(), default=-1)  # the store drops the oldest beyond a thousand, so places in it move
    flow_files.write_model_rows(rows, str(tmp_path / "days"))
    flow_files.archive_old(spark, str(tmp_path / "days"), str(tmp_path / "old"), dt.date(2024, 1, 12))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [e.physicalPlanDescription() for i, e in listed().items() if i > last]
    assert plans and not any("Sort" in p for p in plans)
    assert spark.conf.get(flow_files.OPEN_WRITERS, "0") == "0"


def test_incremental_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    header = ",".join([*fv.MODEL_FEATURES, "FlowStartTime"])
    line = lambda v: ",".join([str(v)] * 38 + ["1704067200.5"])
    (tmp_path / "in" / "a.csv").write_text(f"{header}\n{line(1)}\n{line('CORRUPT')}\n")

    def drain():
        query = (flow_files.stream_model_csv(spark, str(tmp_path / "in")).writeStream.format("parquet")
                 .option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
                 .trigger(availableNow=True).start())
        query.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert drain().count() == 2
    (tmp_path / "in" / "b.csv").write_text(f"{header}\n{line(3)}\n")
    rows = drain()  # a restart reads the new file only
    assert rows.count() == 3 and rows.filter("DestinationPort is null").count() == 1
    (tmp_path / "odd.csv").write_text(" DestinationPort,FlowStartTime , note\n80,1.5,x\nzz,2,y\n")
    odd = flow_files.read_model_csv(spark, str(tmp_path / "odd.csv")).orderBy("FlowStartTime").collect()
    assert [(r.DestinationPort, r.FlowStartTime, r.note, r.FINFlagCount) for r in odd] == [(80, 1.5, "x", None), (None, 2, "y", None)]


def test_truth_log_file(spark, tmp_path):
    path = tmp_path / "gt.csv"
    path.write_text("﻿unix_us,event,attack_type,detail\r\n1000000,PHASE_START,a,x\r\n2000000,PHASE_START,a,\"y, z\"\r\n"
                    "bad,PHASE_END,a,\r\n3000000,PHASE_END,a,\r\n4000000,PHASE_END,a,\r\n5000000,PHASE_END,b,\r\n", encoding="utf-8")
    log = flow_files.read_truth_log(spark, str(path), "c")
    assert [tuple(r) for r in learning.truth_windows(log, offset=10).collect()] == [("c", 12.0, 13.0, "ATTACK")]
    assert flow_files.read_truth_log(spark, str(tmp_path / "none.csv"), "c").count() == 0


def test_alert_export(spark, sf_dir, tmp_path):
    alerts = views.alerts(spark, sf_dir).withColumn("evidence", F.lit('{"a": "b, c"}')).withColumn("nested", F.array(F.lit(1)))
    flow_files.export_alerts(alerts, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.count() == alerts.count() and back.filter("evidence = '{\"a\": \"b, c\"}' and nested = '[1]'").count() == back.count()


def test_model_table(spark):
    first = models.to_row(spark, network.model(), 2, 4, "round-4", 3, 1.0)
    narrow = first.withColumns({"round": F.lit(5), "coefs": F.transform("coefs", lambda w: w.withField("rows", F.lit(7)))})
    loaded = models.load(first.unionByName(narrow))
    assert all(np.allclose(a, b) for a, b in zip(loaded.coefs, network.model().coefs))
    with pytest.raises(ValueError, match="no model"):
        models.load(narrow)
    with pytest.raises(ValueError, match="class order"):
        models.load(first, classes=(1, 0))


def test_tail_reads_what_was_appended(tmp_path):
    reader, path = flow_tail.TailReader(str(tmp_path), 7), tmp_path / "a" / "x.csv"
    path.parent.mkdir()

    def read(start):
        end = reader.latestOffset()
        rows = [(r["header"], r["at"], r["value"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        return end, rows

    path.write_bytes("﻿h,é\r\n".encode() + b"1,a\nlonger than a piece, by far,bb\n\nhalf")
    end, rows = read({})
    assert [r[2] for r in rows] == ["1,a", "longer than a piece, by far,bb", ""] and {r[0] for r in rows} == {"h,é"}
    assert read(end)[1] == []
    with path.open("ab") as f:
        f.write(b" line\n3\n")
    again, rows = read(end)
    assert [r[2] for r in rows] == ["half line", "3"]
    assert read(end) == (again, rows)  # a replayed micro-batch
    path.write_bytes(b"k\nnew\n")  # shorter
    cut, rows = read(again)
    assert [(r[0], r[2]) for r in rows] == [("k", "new")]
    path.write_bytes(b"k\nNEW\n")  # as long, but other bytes
    same, rows = read(cut)
    assert [r[2] for r in rows] == ["NEW"]
    (tmp_path / "b.csv").write_bytes(b"no end")
    (tmp_path / "c.txt").write_bytes(b"x\ny\n")
    assert read(same)[1] == [] and flow_tail.TailReader(str(tmp_path / "none"), 7).latestOffset() == {}
    many = b"h\n" + b"".join(b"%d\n" % i for i in range(30_000))
    (tmp_path / "b.csv").write_bytes(many)
    wide = flow_tail.TailReader(str(tmp_path), 100_003)
    pieces = wide.partitions(same, wide.latestOffset())
    assert len(pieces) == 2 and [r["value"] for p in pieces for b in wide.read(p) for r in b.to_pylist()] == [str(i) for i in range(30_000)]


def test_published_lists_are_of_one_version(spark, tmp_path):
    lists = indicators.default_indicators(spark)
    indicators.publish(lists, str(tmp_path), 1)
    half = indicators.Indicators(lists.domains.limit(0), lists.addresses, lists.process_names, lists.process_chains)
    half.domains.select(F.lit("domains").alias("list"), "entry", "is_suffix").write.parquet(str(tmp_path / "entries/version=2"))
    version, now = indicators.current(spark, str(tmp_path))  # not pointed to yet
    assert version == 1 and {r.list: r.entries for r in now.sizes().collect()} == {r.list: r.entries for r in lists.sizes().collect()}
    indicators.publish(half, str(tmp_path), 2)
    version, now = indicators.current(spark, str(tmp_path))
    assert version == 2 and now.domains.count() == 0 and now.addresses.count() == lists.addresses.count()
