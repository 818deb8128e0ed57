"""Alert store: ingest, search, dashboards, clients."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import host, network, views
from checks.register import registrar
from nightwarden import fixed_values as fv
from nightwarden.plans import alert_search, alert_store as store, host_detection, learning
from nightwarden.session import checkpoint_dir, checkpointed

QUERIES, ORACLES, query = registrar()


A = f"al AS ({views.select_sql(views.ALERTS, 'events')})"
# Time of the newest alert, so that the checks hold at every table size.
AS_OF = views.BASE + 4000.0
UNIQUE = "un AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY received_at, arrival) = 1)"


def merged_sql(source: str) -> str:
    return f"""gap AS (SELECT *, CASE WHEN received_at - lag(received_at) OVER w <= {fv.MERGE_SECONDS} THEN 0 ELSE 1 END AS opens FROM {source}
  WINDOW w AS (PARTITION BY client_id, attack_type, track ORDER BY received_at, arrival)),
ses AS (SELECT *, sum(opens) OVER (PARTITION BY client_id, attack_type, track ORDER BY received_at, arrival) AS sid FROM gap),
mer AS (SELECT client_id, attack_type, track, arg_min(alert_id, arrival) AS alert_id, arg_min(client_ip, arrival) AS client_ip, arg_min(severity, arrival) AS severity,
  max(received_at) AS received_at, CAST(sum(greatest(event_count, 1)) AS BIGINT) AS event_count, max(confidence) AS confidence,
  coalesce(arg_min(nullif(rule_id, ''), arrival) FILTER (rule_id <> ''), '') AS rule_id, coalesce(arg_min(mitre_id, arrival) FILTER (mitre_id <> ''), '') AS mitre_id,
  'open' AS status FROM ses GROUP BY client_id, attack_type, track, sid)"""


MERGED_COLUMNS = ("alert_id", "client_id", "attack_type", "track", "client_ip", "severity", "received_at", "event_count", "confidence", "rule_id", "mitre_id", "status")
STORE = f"{A}, {UNIQUE}, {merged_sql('un')}"


def raw(spark, sf_dir):
    return views.alerts(spark, sf_dir)


def stored(spark, sf_dir):
    return store.ingest(raw(spark, sf_dir)).select(*MERGED_COLUMNS)


@query("alert_batch_flatten", f"WITH {A} SELECT client_id, alert_id, severity, confidence FROM al")
def alert_batch_flatten(spark, sf_dir):
    one = F.struct("alert_id", "severity", "confidence")
    batches = raw(spark, sf_dir).groupBy("client_id", F.expr("arrival div 20").alias("batch")).agg(F.collect_list(one).alias("alerts"))
    return store.flatten_batches(batches).select("client_id", "alert_id", "severity", "confidence")


NO_ID = "arrival % 9 = 4"


@query("alert_ids", f"""WITH {A}, sent AS (SELECT * REPLACE (CASE WHEN {NO_ID} THEN CASE WHEN arrival % 2 = 0 THEN '' END ELSE alert_id END AS alert_id) FROM al),
kept AS (SELECT * FROM sent WHERE coalesce(alert_id, '') = '' UNION ALL (SELECT * FROM sent WHERE alert_id <> '' QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY received_at, arrival) = 1))
SELECT arrival, received_at, client_id, coalesce(alert_id, '') = '' AS derived FROM kept""")
def alert_ids(spark, sf_dir):
    """Alerts sent with an empty or no id are all kept, each under an id of its own."""
    sent = raw(spark, sf_dir).withColumn("alert_id", F.when(F.expr(NO_ID), F.when(F.expr("arrival % 2 = 0"), F.lit(""))).otherwise(F.col("alert_id")))
    return store.unique_alerts(sent).select("arrival", "received_at", "client_id", (F.length("alert_id") == 64).alias("derived"))


JUDGED = "severity = 2"


@query("alert_merge_into_store", f"""WITH {STORE}, began AS (SELECT alert_id, min(received_at) AS first_at FROM un GROUP BY 1)
SELECT {', '.join(f'mer.{c}' for c in MERGED_COLUMNS[:-1])}, CASE WHEN {JUDGED} AND first_at < (SELECT avg(received_at) FROM al) THEN 'resolved' ELSE 'open' END AS status
FROM mer JOIN began USING (alert_id)""")
def alert_merge_into_store(spark, sf_dir):
    """Half of the alerts ingested and partly judged, the other half merged in as a batch."""
    sent = raw(spark, sf_dir)
    cut = sent.agg(F.avg("received_at")).scalar()
    earlier, batch = sent.filter(F.col("received_at") < cut), sent.filter(F.col("received_at") >= cut)
    first = store.ingest(earlier).withColumn("status", F.when(F.expr(JUDGED), "resolved").otherwise("open"))
    changed = store.merge_into_store(first, batch, earlier.select("alert_id")).select(*MERGED_COLUMNS)
    return first.join(changed, "alert_id", "left_anti").select(*MERGED_COLUMNS).unionByName(changed)


@query("alert_dedupe", f"WITH {A}, {UNIQUE} SELECT alert_id, arrival, received_at, client_id, severity FROM un")
def alert_dedupe(spark, sf_dir):
    return store.unique_alerts(raw(spark, sf_dir)).select("alert_id", "arrival", "received_at", "client_id", "severity")


@query("burst_merge", f"WITH {A}, {merged_sql('al')} SELECT {', '.join(MERGED_COLUMNS)} FROM mer")
def burst_merge(spark, sf_dir):
    # Short chunks, so that sessions cross chunk borders here too.
    return store.merge_bursts(raw(spark, sf_dir), chunk_seconds=90.0).select(*MERGED_COLUMNS)


@query("alert_ingest", f"WITH {STORE} SELECT {', '.join(MERGED_COLUMNS)} FROM mer")
def alert_ingest(spark, sf_dir):
    return stored(spark, sf_dir)


_FILTERS = {
    "alert_search": ({"min_severity": 3, "rule_id": "SCAN", "client_id": "pc-"},
                     "severity >= 3 AND (rule_id ILIKE '%SCAN%' OR attack_type ILIKE '%SCAN%') AND client_id ILIKE '%pc-%'"),
    "alert_search_wildcard": ({"track": 2, "rule_id": "port_s%an"}, "track = 2 AND (rule_id ILIKE '%port_s%an%' OR attack_type ILIKE '%port_s%an%')"),
}
for _name, (_kw, _where) in _FILTERS.items():
    query(_name, f"WITH {A} SELECT arrival, alert_id, client_id, severity, track, rule_id FROM al WHERE {_where}")(
        lambda spark, sf_dir, kw=_kw: store.search(raw(spark, sf_dir), **kw).select("arrival", "alert_id", "client_id", "severity", "track", "rule_id"))


def indexed_store(spark, alerts) -> str:
    where = f"{checkpoint_dir(spark)}/alerts-{uuid.uuid4().hex}"
    alert_search.write_store(alerts, where)
    return where


# Alerts on forty days.
SPREAD = {**views.ALERTS, "received_at": f"CAST({views.CLOCK_MS} AS DOUBLE) / 1000 + event_id % 40 * 86400"}
for _name, (_kw, _where) in _FILTERS.items():
    query(f"{_name}_indexed", f"WITH al AS ({views.select_sql(SPREAD, 'events')}) SELECT arrival, alert_id, client_id, severity, track, rule_id FROM al WHERE {_where}")(
        lambda spark, sf_dir, kw=_kw: alert_search.search(spark, indexed_store(spark, views.project(views.read(spark, sf_dir, "events"), SPREAD)), **kw).select(
            "arrival", "alert_id", "client_id", "severity", "track", "rule_id"))


@query("paged_alerts_keyset", f"""WITH al AS ({views.select_sql(SPREAD, 'events')}), un AS (SELECT alert_id, min(received_at) AS received_at, min_by(severity, received_at) AS severity FROM al GROUP BY 1)
SELECT alert_id, received_at FROM un WHERE severity >= 2 ORDER BY received_at DESC, alert_id LIMIT 400 OFFSET 800""")
def paged_alerts_keyset(spark, sf_dir):
    """The third page by key: each page starts after the last alert of the one before."""
    alerts = views.project(views.read(spark, sf_dir, "events"), SPREAD)
    where, after = indexed_store(spark, store.unique_alerts(alerts)), None
    for _ in range(3):
        page = checkpointed(alert_search.page_after(spark, where, after, 400, F.col("severity") >= 2))
        last = page.orderBy("received_at", F.desc("alert_id")).select("received_at", "alert_id").first()
        if last is None:
            break
        after = tuple(last)
    return page.select("alert_id", "received_at")


@query("paged_alerts", f"WITH {STORE} SELECT alert_id, received_at FROM mer WHERE severity >= 2 ORDER BY received_at DESC, alert_id LIMIT 25 OFFSET 50")
def paged_alerts(spark, sf_dir):
    found = store.search(stored(spark, sf_dir), min_severity=2)
    return store.page(found, limit=25, offset=50).select("alert_id", "received_at")


@query("filtered_total", f"WITH {STORE} SELECT count(*) AS total FROM mer WHERE severity >= 2 AND track = 1")
def filtered_total(spark, sf_dir):
    return store.search(stored(spark, sf_dir), min_severity=2, track=1).agg(F.count("*").alias("total"))


@query("alerts_by_severity", f"""WITH {A} SELECT v.severity, count(al.severity) AS alerts FROM (VALUES (0), (1), (2), (3), (4)) v(severity)
LEFT JOIN al ON al.severity = v.severity AND received_at >= {AS_OF} - 3600 GROUP BY 1""")
def alerts_by_severity(spark, sf_dir):
    return store.by_severity(store.since(raw(spark, sf_dir), AS_OF, hours=1))


@query("alerts_by_track", f"""WITH {A} SELECT v.track, count(al.track) AS alerts FROM (VALUES (0), (1), (2)) v(track)
LEFT JOIN al ON al.track = v.track AND received_at >= {AS_OF} - 86400 GROUP BY 1""")
def alerts_by_track(spark, sf_dir):
    return store.by_track(store.since(raw(spark, sf_dir), AS_OF))


@query("top_attack_types", f"WITH {STORE} SELECT attack_type, count(*) AS alerts FROM mer WHERE attack_type <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_attack_types(spark, sf_dir):
    return store.top_attack_types(stored(spark, sf_dir))


@query("client_track_counts", f"WITH {A} SELECT client_id, count_if(track = 1) AS host_alerts, count_if(track = 2) AS net_alerts FROM al GROUP BY 1")
def client_track_counts(spark, sf_dir):
    return store.per_client_tracks(raw(spark, sf_dir))


def changes(spark, sf_dir):
    return raw(spark, sf_dir).filter("status_sent is not null").select(
        "alert_id", F.col("status_sent").alias("status"), F.col("received_at").alias("changed_at"), "arrival")


STATUS = f"""{STORE}, ch AS (SELECT alert_id AS changed_id, arg_max(status_sent, arrival) AS new_status FROM al WHERE status_sent IN ('open', 'resolved', 'false_positive') GROUP BY 1),
st AS (SELECT mer.* REPLACE (coalesce(new_status, status) AS status) FROM mer LEFT JOIN ch ON changed_id = alert_id)"""


@query("alert_status", f"WITH {STATUS} SELECT alert_id, status FROM st")
def alert_status(spark, sf_dir):
    return store.current_status(stored(spark, sf_dir), changes(spark, sf_dir)).select("alert_id", "status")


BEATS = f"hb AS ({views.select_sql(views.HEARTBEATS, 'orders')}), cl AS (SELECT * FROM hb QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY last_seen DESC, beat DESC) = 1)"


def clients(spark, sf_dir):
    return store.latest_heartbeats(views.heartbeats(spark, sf_dir))


@query("latest_heartbeat", f"WITH {BEATS} SELECT client_id, beat, client_ip, last_seen, uptime_seconds, host_track_ok, net_track_ok, rule_hits_total FROM cl")
def latest_heartbeat(spark, sf_dir):
    return clients(spark, sf_dir)


SEEN_AT = views.BASE + 5010.0


@query("client_liveness", f"WITH {BEATS} SELECT client_id, last_seen, {SEEN_AT} - last_seen < 180 AS online, CAST(trunc({SEEN_AT} - last_seen) AS BIGINT) AS last_seen_ago FROM cl")
def client_liveness(spark, sf_dir):
    return store.liveness(clients(spark, sf_dir), SEEN_AT).select("client_id", "last_seen", "online", "last_seen_ago")


@query("clients_by_last_seen", f"WITH {BEATS} SELECT client_id, last_seen FROM cl ORDER BY last_seen DESC, client_id")
def clients_by_last_seen(spark, sf_dir):
    return store.liveness(clients(spark, sf_dir), SEEN_AT).select("client_id", "last_seen")


@query("status_rollup", f"""WITH {STORE}, {BEATS}, up AS ({views.select_sql(views.UPDATES, 'embeddings')}),
mo AS (SELECT track, max(base_round) - 1 AS round, count(DISTINCT client_id) AS n, max(received_at) AS t FROM up GROUP BY track)
SELECT (SELECT count(*) FROM mer) AS total_alerts, (SELECT count_if({SEEN_AT} - last_seen < 180) FROM cl) AS online_clients, (SELECT count(*) FROM cl) AS total_clients,
  round AS model_round, 'round-' || CAST(round AS VARCHAR) AS model_version, CAST(n AS INT) AS model_clients, t AS model_updated_at,
  (SELECT count(*) FROM up WHERE base_round >= (SELECT max(round) FROM mo WHERE track = 2)) AS pending_updates, 1 AS min_clients FROM mo WHERE track = 2""")
def status_rollup(spark, sf_dir):
    updates = views.updates(spark, sf_dir)
    number = F.max("base_round") - 1
    models = updates.groupBy("track").agg(
        number.alias("round"), F.concat(F.lit("round-"), number.cast("string")).alias("version"),
        F.count_distinct("client_id").cast("int").alias("client_count"), F.max("received_at").alias("updated_at"))
    return store.status(stored(spark, sf_dir), clients(spark, sf_dir), models, updates, SEEN_AT)


@query("alert_union", f"""{host.every_rule_sql()}, {network.SCORED}, {network.META}, {network.BURST.replace("dom AS", "main_type AS")}, {network.RULES}, {network.rule_hits_sql()},
net_alerts AS ({network.FLOW_ALERTS} UNION ALL {network.BURST_ALERTS.replace("JOIN dom ", "JOIN main_type ")} UNION ALL {network.RULE_ALERTS})
SELECT track, attack_type, severity, count(*) AS alerts, CAST(sum(event_count) AS BIGINT) AS events FROM (SELECT 1 AS track, attack_type, severity, event_count FROM found
 UNION ALL SELECT track, attack_type, severity, event_count FROM net_alerts) GROUP BY 1, 2, 3""")
def alert_union(spark, sf_dir):
    host_alerts = host_detection.alerts(host.all_detections(spark, sf_dir), F.lit("2024-01-02T00:00:00Z"))
    network_alerts = network.net.network_alerts(network.scored(spark, sf_dir))
    return store.union_tracks(host_alerts, network_alerts).groupBy("track", "attack_type", "severity").agg(
        F.count("*").alias("alerts"), F.sum("event_count").alias("events"))


SECONDS = lambda c: f"TRY_CAST({c} AS DOUBLE)"
FEEDBACK_STORE = f"""{A}, {UNIQUE}, ch AS (SELECT alert_id AS changed_id, arg_max(status_sent, arrival) AS new_status FROM al WHERE status_sent IN ('open', 'resolved', 'false_positive') GROUP BY 1),
fb AS (SELECT client_id, {SECONDS('window_start')} AS lo, {SECONDS('window_end')} AS hi, CASE WHEN new_status = 'false_positive' THEN 'BENIGN' ELSE 'ATTACK' END AS label
 FROM un JOIN ch ON changed_id = alert_id WHERE new_status <> 'open' AND received_at >= {AS_OF} - 7 * 86400 AND {SECONDS('window_start')} IS NOT NULL)"""


def feedback(spark, sf_dir):
    judged = store.current_status(store.unique_alerts(raw(spark, sf_dir)), changes(spark, sf_dir))
    return learning.feedback_windows(judged, AS_OF)


@query("feedback_windows", f"WITH {FEEDBACK_STORE} SELECT client_id, lo AS window_start, hi AS window_end, label FROM fb")
def feedback_windows(spark, sf_dir):
    return feedback(spark, sf_dir)
