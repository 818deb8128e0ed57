"""Streaming forms over the given tables, checked against the same SQL as the batch forms.

Each query reads its table as a stream that is given four parts, one after the other, and starts
anew from its checkpoint for each, so that state lives across micro-batches and restarts. A last
part with rows far in the future, far apart, moves the watermark past all others; alone, none of
them fires, and the last stays in the state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import alerts, host, network_flows, views
from checks.register import registrar
from nightwarden import fixed_ioc_lists, fixed_values as fv
from nightwarden.plans import flows, host_detection
from nightwarden.session import checkpoint_dir
from nightwarden.sources import indicators
from nightwarden.streaming import alert_ids, alert_stream, flow_stream, host_stream, latest_table

QUERIES, ORACLES, query = registrar()
PARTS, AHEAD = 4, 1_000_000


class Feed:
    """A table as a stream that gets a part of it at a time, in order of its ids."""

    def __init__(self, spark, sf_dir, ahead: int = 1, table: str = "events", number: str = "event_id"):
        events = views.read(spark, sf_dir, table).withColumnRenamed(number, "event_id")
        self.folder = f"{checkpoint_dir(spark)}/{table}-{uuid.uuid4().hex}"
        first, last = events.agg(F.min("event_id"), F.max("event_id")).first()
        step = (last - first) // PARTS + 1
        # Filters sink below the watermark, so among the rows ahead there must be one that passes them.
        far = F.col("event_id") + AHEAD * (1 + last - F.col("event_id"))
        far_rows = events.filter(F.col("event_id") > last - ahead).withColumn("event_id", far.cast(events.schema["event_id"].dataType))
        self.parts = [events.filter(F.col("event_id").between(low, low + step - 1)) for low in range(first, last + 1, step)] + [far_rows]
        events.limit(0).write.parquet(self.folder)
        self.frame = spark.readStream.schema(events.schema).parquet(self.folder).withColumnRenamed("event_id", number)

    def given(self, run, before=lambda n: None):
        """Give the stream part after part and run it on each, restarted from its checkpoint."""
        for n, part in enumerate(self.parts):
            before(n)
            part.write.mode("append").parquet(self.folder)
            run().awaitTermination()

    def settled(self, df):
        """The result of a stream over all parts, as a table."""
        folder = f"{self.folder}-out"
        self.given(lambda: df.writeStream.format("parquet").option("path", f"{folder}/out")
                   .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def settled(spark, df):
    """Run a stream over all present input; the result as a table."""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    running = (df.writeStream.format("parquet").option("path", f"{folder}/out")
               .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


_WATCHED = {r: host.WATCHED[r] for r in host.WATCHED}
_PARTS, _CTES = [], []
for _i, _rule in enumerate(_WATCHED):
    _chain = f"watched AS ({_WATCHED[_rule]}), {host.COUNTED}, {host.FIRED % host.REACHED[_rule]}"
    for _name in ("watched", "counted", "hits", "fired"):
        import re
        _chain = re.sub(rf"\b{_name}\b", f"{_name}{_i}", _chain)
    _CTES.append(_chain)
    _PARTS.append(f"SELECT '{_rule}' AS rule, computer, source, log_id, total AS window_total, uniq AS window_distinct FROM hits{_i} "
                  f"WHERE log_id IN (SELECT log_id FROM fired{_i})")


@query("stream_threshold_fires", f"WITH RECURSIVE {host.H}, " + ", ".join(_CTES) + " " + " UNION ALL ".join(_PARTS))
def stream_threshold_fires(spark, sf_dir):
    feed = Feed(spark, sf_dir, ahead=200)
    events = views.host_events_of(feed.frame)
    fires = feed.settled(host_stream.threshold_fires(events, delay="0 seconds"))
    return fires.select(
        "rule", "computer", "source", "log_id", "window_total", "window_distinct")


@query("stream_host_alerts", host.every_rule_sql() + """SELECT sha256(rule_id || '|' || computer || '|' || CAST(log_id AS VARCHAR)) AS alert_id, computer AS client_id,
  attack_type, severity, confidence, event_count, evidence, rule_id, mitre_id FROM found WHERE rule_id IN ('brute_force_logon', 'password_spray', 'net_portscan')""")
def stream_host_alerts(spark, sf_dir):
    """The alerts of the counting rules as a stream gives them."""
    feed = Feed(spark, sf_dir, ahead=200)
    events = views.host_events_of(feed.frame)
    found = feed.settled(host_stream.threshold_detections(events, delay="0 seconds"))
    return host_detection.alerts(found, F.lit("2024-01-02T00:00:00Z")).select(
        "alert_id", "client_id", "attack_type", "severity", "confidence", "event_count", "evidence", "rule_id", "mitre_id")


@query("stream_flow_assembly", f"""WITH RECURSIVE {network_flows.flow_ctes(flush_idle=True)}
SELECT flow_seq, any_value(flow_src) AS flow_src_ip, count(*) AS packets, count_if(fwd) AS fwd_packets, max(ts_us) - min(ts_us) AS duration_us
FROM p GROUP BY flow_seq""")
def stream_flow_assembly(spark, sf_dir):
    feed = Feed(spark, sf_dir)
    packets = views.project(feed.frame, views.PACKETS)
    done = feed.settled(flow_stream.finished_flows(packets, delay="0 seconds"))
    return done.select(
        F.col("anchor_order").alias("flow_seq"), "flow_src_ip", F.col("len_n").cast("bigint").alias("packets"),
        F.col("fwd_len_n").cast("bigint").alias("fwd_packets"), (F.col("last_us") - F.col("first_us")).alias("duration_us"))


FLUSHED = (f"WITH RECURSIVE {network_flows.flow_ctes(flush_idle=True)}, {network_flows.IAT}, {network_flows.ACTIVE}, "
           f"{network_flows.RUNS},\n{network_flows.features_sql()}")


@query("stream_flow_features", f"{FLUSHED}\nSELECT {network_flows.show_sql()} FROM flows84")
def stream_flow_features(spark, sf_dir):
    """The 84 columns of flows that a stream folds packet by packet."""
    feed = Feed(spark, sf_dir)
    packets = views.project(feed.frame, views.PACKETS)
    done = feed.settled(flow_stream.finished_flows(packets, delay="0 seconds"))
    return network_flows.shown(flows.state_features(done))


_STREAMED = ("client_id", "attack_type", "track", "alert_id", "event_count", "confidence", "rule_id", "mitre_id", "received_at")


@query("stream_burst_merge", f"WITH {alerts.STORE} SELECT {', '.join(_STREAMED)} FROM mer")
def stream_burst_merge(spark, sf_dir):
    feed = Feed(spark, sf_dir)
    sent = views.project(feed.frame, views.ALERTS)
    merged = feed.settled(alert_stream.merged_bursts(sent, gap_seconds=fv.MERGE_SECONDS))
    return merged.select(*_STREAMED)


def _listed(every: int, events: str) -> str:
    """Hits of the indicator rules with every n-th list entry, over some events."""
    rows = host.list_rows(every)
    return " UNION ALL ".join(
        f"SELECT * FROM (WITH {host.H}, {rows[rule]} SELECT log_id, '{rule}' AS rule_id, hit FROM ({match})) WHERE {events}"
        for rule, (_, match) in host.IOC_CTES.items())


_FIRST_PART = f"(SELECT min(event_id) + (max(event_id) - min(event_id)) // {PARTS} + 1 FROM events)"


@query("stream_ioc_reload", f"""SELECT log_id, rule_id, 1 AS lists_version, count(*) AS n FROM ({_listed(1, f"log_id < {_FIRST_PART}")}) GROUP BY ALL
UNION ALL SELECT log_id, rule_id, 2, count(*) FROM ({_listed(2, f"log_id >= {_FIRST_PART}")}) GROUP BY ALL""")
def stream_ioc_reload(spark, sf_dir):
    """Lists that change between two micro-batches: each event is judged by the version of its batch."""
    feed, whole = Feed(spark, sf_dir), indicators.default_indicators(spark)
    lists, out = f"{feed.folder}-lists", f"{feed.folder}-found"

    def publish(part):
        if part == 0:
            indicators.publish(whole, lists, 1)
        elif part == 1:  # every second entry is gone
            halves = (indicators.read_text(spark, "\n".join(host._list(t)[::2])) for t in (
                fixed_ioc_lists.DOMAINS, fixed_ioc_lists.ADDRESSES, fixed_ioc_lists.PROCESS_NAMES, fixed_ioc_lists.PROCESS_CHAINS))
            indicators.publish(indicators.from_lines(*halves), lists, 2)

    judge = host_stream.published_detections(spark, lists)
    feed.parts.pop()  # no state, no watermark
    feed.given(lambda: host_stream.write_batches(views.host_events_of(feed.frame), out, f"{out}-state", judge, trigger={"availableNow": True}), publish)
    found = spark.read.parquet(out)
    return found.groupBy("log_id", "rule_id", "lists_version").agg(F.count("*").alias("n"))


# Alerts of the second half that are sent under the id of one of the first half, long after it.


@query("stream_alert_ids", f"""WITH {alerts.A}, span AS (SELECT (max(event_id) - min(event_id)) // 2 + 1 AS half, min(event_id) AS min_id FROM events),
sent AS (SELECT al.* REPLACE (CASE WHEN arrival % 50 = 7 AND arrival - min_id >= half THEN 'a' || CAST(arrival - half AS VARCHAR) ELSE alert_id END AS alert_id) FROM al, span)
SELECT alert_id, arrival, received_at, client_id FROM sent QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY received_at, arrival) = 1""")
def stream_alert_ids(spark, sf_dir):
    """Ids sent again hours after any watermark count as known."""
    feed = Feed(spark, sf_dir)
    feed.parts.pop()  # no watermark
    first, last = views.read(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id")).first()
    half = (last - first) // 2 + 1
    again = (F.col("arrival") % 50 == 7) & (F.col("arrival") - first >= half)
    sent = views.project(feed.frame, views.ALERTS).withColumn(
        "alert_id", F.when(again, F.concat(F.lit("a"), (F.col("arrival") - half).cast("string"))).otherwise(F.col("alert_id")))
    ids, out = alert_ids.AlertIds(spark, f"{feed.folder}-ids", blocks=1 << 12), f"{feed.folder}-new"
    keep = alert_ids.first_arrivals(ids)
    feed.given(lambda: host_stream.write_batches(sent, out, f"{out}-state", keep, trigger={"availableNow": True}))
    return spark.read.parquet(out).select("alert_id", "arrival", "received_at", "client_id")


@query("stream_latest_heartbeat", f"""WITH beats AS ({views.select_sql(views.HEARTBEATS, 'orders')})
SELECT client_id, beat, last_seen, uptime_seconds, host_track_ok FROM beats QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY last_seen DESC, beat DESC) = 1""")
def stream_latest_heartbeat(spark, sf_dir):
    """The newest heartbeat of every client; one batch comes twice, and batches are folded on the way."""
    feed = Feed(spark, sf_dir, table="orders", number="o_orderkey")
    feed.parts.pop()  # no watermark
    beats = views.project(feed.frame, views.HEARTBEATS)
    schema = ", ".join(f"{name} {kind}" for name, kind in beats.dtypes)
    table = latest_table.LatestTable(spark, f"{feed.folder}-latest", schema, "client_id", ["last_seen", "beat"])

    def twice(batch, batch_id):
        table.upsert(batch, batch_id)
        if batch_id == 1:
            table.compact(0)
            table.upsert(batch, batch_id)

    feed.given(lambda: beats.writeStream.foreachBatch(twice).option("checkpointLocation", f"{feed.folder}-state").trigger(availableNow=True).start())
    return table.read().select("client_id", "beat", "last_seen", "uptime_seconds", "host_track_ok")
