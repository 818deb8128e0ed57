"""What the file readers and writers do, on lines and days derived from the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from checks import alerts, learn, network, network_flows, streams, views
from checks.register import registrar
from nightwarden import fixed_values as fv
from nightwarden.plans import flows, learning, network_detection as net
from nightwarden.schemas import MODEL_FLOWS
from nightwarden.session import checkpoint_dir
from nightwarden.sources import event_xml, flow_files, flow_tail, models

QUERIES, ORACLES, query = registrar()


def folder(spark, name: str) -> str:
    """A new folder where the cluster keeps its checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


PARSED = f"""WITH {network.FLOW_SQL} SELECT client_id, count(*) AS lines, count_if(flow_no % 17 = 0) AS bad_numbers,
 sum(CASE WHEN flow_no % 17 = 0 THEN 0 ELSE TotalFwdPackets END) AS fwd_packets, max(AveragePacketSize) AS largest, max(FlowStartTime) AS latest FROM fl GROUP BY 1"""


def written_csv(spark, sf_dir, compression: str = "none") -> str:
    """Model rows as CSV files with two column orders and padded names, some cells damaged."""
    rows = views.flows(spark, sf_dir)
    names = ["client_id", *fv.MODEL_FEATURES, "FlowStartTime"]
    bad = (F.col("flow_no") % 17 == 0)
    text = rows.select("flow_no", *[F.when(bad & F.lit(n == "TotalFwdPackets"), F.lit("CORRUPT")).otherwise(F.col(n).cast("string")).alias(n) for n in names])
    where = folder(spark, "csv")
    for part, order in (("a", names), ("b", names[::-1])):
        half = text.filter(F.col("flow_no") % 2 == int(part == "b"))
        half.select(*[F.col(n).alias(f" {n}" if part == "b" else n) for n in order]).write.option("header", True).csv(
            f"{where}/{part}", compression=compression)
    return f"{where}/*"


def parsed(rows):
    return rows.groupBy("client_id").agg(
        F.count("*").alias("lines"), F.count_if(F.col("TotalFwdPackets").isNull()).alias("bad_numbers"),
        F.sum(F.coalesce("TotalFwdPackets", F.lit(0.0))).alias("fwd_packets"), F.max("AveragePacketSize").alias("largest"),
        F.max("FlowStartTime").alias("latest"))


@query("flow_csv_scan", PARSED)
def flow_csv_scan(spark, sf_dir):
    """CSV files whose columns stand in different orders, each read by its own header."""
    return parsed(flow_files.read_model_csv(spark, written_csv(spark, sf_dir, "gzip")))  # as text they take 15 times the table's space


@query("flow_csv_stream", PARSED)
def flow_csv_stream(spark, sf_dir):
    """The same files as a stream, a few per micro-batch."""
    rows = flow_files.stream_model_csv(spark, written_csv(spark, sf_dir), f"{MODEL_FLOWS}, client_id STRING", files_per_trigger=3)
    return parsed(streams.settled(spark, rows))


@query("truth_log_scan", f"WITH {learn.TRUTH} SELECT client_id, round(lo, 6) AS window_start, round(hi, 6) AS window_end, label FROM tw")
def truth_log_scan(spark, sf_dir):
    """Ground-truth logs of many clients, a file each, read in one go."""
    where = folder(spark, "truth")
    log = views.truth_log(spark, sf_dir).select("client_id", "line_no", "unix_us", "event", "attack_type", F.lit("-").alias("detail"))
    log.repartition("client_id").sortWithinPartitions("client_id", "line_no").drop("line_no").write.option("header", True).partitionBy("client_id").csv(where)
    logs = flow_files.read_truth_logs(spark, f"{where}/*", r"client_id=([^/]+)/")
    return learning.truth_windows(logs).withColumns({c: F.round(c, 6) for c in ("window_start", "window_end")})


@query("alert_export", f"WITH {alerts.STORE} SELECT alert_id, client_id, severity, rule_id FROM mer WHERE severity >= 3")
def alert_export(spark, sf_dir):
    """Filtered alerts written as CSV and read back."""
    where = folder(spark, "export")
    flow_files.export_alerts(alerts.store.search(alerts.stored(spark, sf_dir), min_severity=3), where)
    back = spark.read.option("header", True).option("escape", '"').csv(where)
    return back.select("alert_id", "client_id", F.col("severity").cast("int").alias("severity"), F.coalesce("rule_id", F.lit("")).alias("rule_id"))


_DAYS = "FlowStartTime + flow_no % 12 * 86400"


@query("flow_retention", f"""WITH {network.FLOW_SQL}, d AS (SELECT *, CAST(floor(({_DAYS} - {views.BASE}) / 86400) AS INT) AS day_no FROM fl WHERE FlowStartTime IS NOT NULL)
SELECT day_no, count(*) AS flows FROM d WHERE day_no >= 11 - {fv.RETAIN_DAYS} GROUP BY 1""")
def flow_retention(spark, sf_dir):
    """Flows of the days that are still kept on 12 January."""
    import datetime as dt
    rows = views.flows(spark, sf_dir).filter("FlowStartTime is not null").withColumn("FlowStartTime", F.expr(_DAYS))
    kept = flow_files.retained(flow_files.with_flow_date(rows), dt.date(2024, 1, 12))
    day = F.datediff("flow_date", F.lit(dt.date(2024, 1, 1)))
    return kept.groupBy(day.alias("day_no")).agg(F.count("*").alias("flows"))


@query("flow_archive", f"""WITH {network.FLOW_SQL}, d AS (SELECT *, CAST(floor(({_DAYS} - {views.BASE}) / 86400) AS INT) AS day_no FROM fl WHERE FlowStartTime IS NOT NULL)
SELECT day_no, count(*) AS flows, day_no < 11 - {fv.RETAIN_DAYS} AS archived FROM d GROUP BY 1""")
def flow_archive(spark, sf_dir):
    """Day folders past the retention copied to the archive; the others stay."""
    import datetime as dt
    where, archive = folder(spark, "days"), folder(spark, "archive")
    rows = views.flows(spark, sf_dir).filter("FlowStartTime is not null").withColumn("FlowStartTime", F.expr(_DAYS))
    flow_files.write_model_rows(rows, where)
    kept = flow_files.archive_old(spark, where, archive, dt.date(2024, 1, 12))
    day = F.datediff("flow_date", F.lit(dt.date(2024, 1, 1))).alias("day_no")
    counted = lambda rows, flag: rows.groupBy(day).agg(F.count("*").alias("flows")).withColumn("archived", F.lit(flag))
    return counted(spark.read.parquet(archive), True).unionByName(counted(kept, False))


@query("event_display", """SELECT event_id AS log_id, '4625' AS event_code, 'pc' AS computer,
 '{"Shown":"User ' || CAST(user_id AS VARCHAR) || '","param1":"' || event_type || '","data_2":"x"}' AS shown FROM events""")
def event_display(spark, sf_dir):
    """The event data as written, names in lower case included, user data left out."""
    xml = F.format_string(
        "<Event><System><Provider Name='P'/><EventID>4625</EventID><Computer>pc</Computer></System><EventData><Data Name='Shown'>User %d</Data>"
        "<Data Name='param1'>%s</Data><Data>x</Data></EventData><UserData><E><Hidden>1</Hidden></E></UserData></Event>", F.col("user_id"), F.col("event_type"))
    raw = views.read(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), xml.alias("raw_xml"))
    return event_xml.nested_view(raw).select("log_id", "event_code", "computer", F.col("data_json").alias("shown"))


@query("event_user_data", """SELECT event_id AS log_id, 'u' || CAST(user_id AS VARCHAR) AS subject, 'a<b & ' || event_type AS cause, 'first' AS twice, 'first' AS twice_lower FROM events""")
def event_user_data(spark, sf_dir):
    """Every leaf of user data, whatever its name; the first value of a name wins."""
    xml = F.format_string(
        "<Event><System><EventID>1102</EventID></System><UserData><l:Log xmlns:l='urn:l'><l:SubjectUserName>u%d</l:SubjectUserName>"
        "<PossibleCause kind='x'> a&lt;b &amp; %s</PossibleCause><Twice>first</Twice><Twice>second</Twice><Empty></Empty></l:Log></UserData></Event>",
        F.col("user_id"), F.col("event_type"))
    raw = views.read(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), xml.alias("raw_xml"))
    return event_xml.parse_events(raw).filter(F.map_contains_key("data", F.lit("Empty")) == F.lit(False)).select(
        "log_id", F.col("data")["SubjectUserName"].alias("subject"), F.col("data")["possiblecause"].alias("cause"),
        F.col("data")["Twice"].alias("twice"), F.col("data")["twice"].alias("twice_lower"))


@query("trimmed_flow_columns", f"WITH {network.FLOW_SQL} SELECT count(*) AS n, sum(DestinationPort) AS ports FROM fl")
def trimmed_flow_columns(spark, sf_dir):
    padded = views.flows(spark, sf_dir).withColumnRenamed("DestinationPort", "  DestinationPort ")
    return net.trimmed_names(padded).agg(F.count("*").alias("n"), F.sum("DestinationPort").alias("ports"))


@query("latest_update_per_client", f"WITH {learn.UP} SELECT track, client_id, max(update_no) AS update_no FROM up GROUP BY 1, 2")
def latest_update_per_client(spark, sf_dir):
    return learning.latest_per_client(views.updates(spark, sf_dir)).select("track", "client_id", "update_no")


@query("flow84_sink", f"""{network_flows.ALL_FLOW_CTES}
SELECT {network_flows.show_sql().removeprefix("flow_seq, ")} FROM flows84""")
def flow84_sink(spark, sf_dir):
    """The 84 columns written as flow files with a header line and read back by it."""
    where = folder(spark, "flows84")
    flow_files.write_flows84(flows.packet_features(network_flows.packets(spark, sf_dir)), where)
    back = flow_files.read_flows84(spark, where)
    return back.select(*[F.round(F.col(f"`{n}`"), 4).alias(n) if n in network_flows.DOUBLES else F.col(f"`{n}`") for n in fv.FLOW_COLUMNS])


@query("daily_files", f"""WITH {network.FLOW_SQL}, d AS (SELECT *, CAST(floor(({_DAYS} - {views.BASE}) / 86400) AS INT) AS day_no FROM fl WHERE FlowStartTime IS NOT NULL)
SELECT client_id, count(*) AS flows, sum(TotalFwdPackets) AS fwd_packets FROM d WHERE day_no = 4 GROUP BY 1""")
def daily_files(spark, sf_dir):
    """The flow files of 5 January, chosen by their folder."""
    import datetime as dt
    where, day = folder(spark, "daily"), dt.date(2024, 1, 5)
    rows = views.flows(spark, sf_dir).filter("FlowStartTime is not null").withColumn("FlowStartTime", F.expr(_DAYS))
    flow_files.write_model_rows(rows, where)
    return flow_files.read_days(spark, where, day, day).groupBy("client_id").agg(
        F.count("*").alias("flows"), F.sum("TotalFwdPackets").alias("fwd_packets"))


# Rounds whose vector has a scaler take eight figures; the others claim nine.
@query("model_scan", """WITH newest AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS w FROM embeddings
  WHERE label % 5 <> 0 AND vec_id % 3 = 0 ORDER BY vec_id DESC LIMIT 1),
numbers AS (SELECT vec_id, w, unnest(range(0, 60)) AS i FROM newest)
SELECT vec_id AS round, CASE WHEN i < 32 THEN 'coefs_0' WHEN i < 44 THEN 'coefs_1' WHEN i < 48 THEN 'intercepts_0' WHEN i < 51 THEN 'intercepts_1' END AS part,
  CASE WHEN i < 32 THEN i WHEN i < 44 THEN i - 32 WHEN i < 48 THEN i - 44 ELSE i - 48 END AS place, round(w[i + 1], 6) AS value
FROM numbers WHERE i < 51""")
def model_scan(spark, sf_dir):
    """The newest round that fits the feature list, read from a table in which newer ones do not."""
    updates = views.updates(spark, sf_dir).filter(f"track = {fv.TRACK_NETWORK}")
    fits = F.size("scaler_mean") > 0
    wide = F.transform("coefs", lambda layer: layer.withField("rows", layer["rows"] + F.when(fits, 0).otherwise(1)))
    eight = lambda name: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.try_element_at(name, F.pmod(i, F.lit(6)) + 1))
    table = updates.select(
        "track", F.col("update_no").cast("int").alias("round"), F.lit("v").alias("version"), F.lit(1).alias("client_count"),
        F.col("received_at").alias("updated_at"), wide.alias("coefs"), "intercepts", eight("scaler_mean").alias("scaler_mean"),
        eight("scaler_scale").alias("scaler_scale"))
    model, round_ = models.load_round(table, features=fv.MODEL_FEATURES[:8])
    parts = {f"{kind}_{i}": a.ravel().tolist() for kind in ("coefs", "intercepts") for i, a in enumerate(getattr(model, kind))}
    rows = [(round_, part, place, float(value)) for part, values in parts.items() for place, value in enumerate(values)]
    return spark.createDataFrame(rows, "round bigint, part string, place bigint, value double").withColumn("value", F.round("value", 6))


TAIL_STEPS = 4
_STEP = f"CAST(l_linenumber % {TAIL_STEPS} AS INT)"


@query("flow_csv_tail", f"""SELECT 'f' || CAST(l_suppkey % 7 AS VARCHAR) AS file, l_linenumber % {TAIL_STEPS} AS step, count(*) AS lines,
  CAST(sum(l_orderkey * 10 + l_linenumber) AS BIGINT) AS flow_sum, round(sum(l_quantity), 2) AS packets FROM lineitem GROUP BY ALL""")
def flow_csv_tail(spark, sf_dir):
    """Files that grow three times between micro-batches; at the third step every second one is replaced."""
    where, out = folder(spark, "tail"), folder(spark, "tail-out")
    lines = views.read(spark, sf_dir, "lineitem").selectExpr(
        "'f' || CAST(l_suppkey % 7 AS STRING) AS file", f"{_STEP} AS step", "l_orderkey * 10 + l_linenumber AS flow_no", "l_quantity AS TotalFwdPackets")
    rows = flow_tail.tail_model_csv(spark, where, "file STRING, step INT, flow_no BIGINT, TotalFwdPackets DOUBLE", piece_bytes=4096)
    os.makedirs(where, exist_ok=True)  # a folder of the clients' own, on shared storage

    def append(step):
        def write(part):
            """One file a task at a time; the last line's end comes with the next step."""
            file = None
            for r in part:
                if file is None or file.name != f"{where}/{r.file}.csv":
                    if file:
                        file.close()
                    path = f"{where}/{r.file}.csv"
                    anew = not os.path.exists(path) or step == 2 and int(r.file[1:]) % 2
                    file = open(path, "w" if anew else "a")
                    file.write("flow_no,TotalFwdPackets,file, step" if anew else "")
                file.write(f"\n{r.flow_no},{r.TotalFwdPackets},{r.file},{r.step}")
            if file:
                file.close()
        lines.filter(F.col("step") == step).repartition("file").sortWithinPartitions("file").foreachPartition(write)

    def drained():
        running = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        running.awaitTermination()

    def end_lines():
        def end(part):
            for r in part:
                with open(f"{where}/{r.file}.csv", "a") as f:
                    f.write("\n")
        lines.select("file").distinct().foreachPartition(end)

    for step in range(TAIL_STEPS):
        if step == 2:  # what is to be replaced must be whole before
            end_lines()
            drained()
        append(step)
        drained()
    end_lines()
    drained()
    return spark.read.schema(rows.schema).parquet(out).groupBy("file", "step").agg(
        F.count("*").alias("lines"), F.sum("flow_no").alias("flow_sum"), F.round(F.sum("TotalFwdPackets"), 2).alias("packets"))
