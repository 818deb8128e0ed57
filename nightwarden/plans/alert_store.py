"""The alert table: ingest, state, search, dashboards, clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightwarden import fixed_values as fv
from nightwarden.operators import sessions

MERGE_KEYS = ["client_id", "attack_type", "track"]
FILLABLE = ("rule_id", "mitre_id", "mitre_tactic", "suggestion", "risk_note")
FROM_FIRST = ("alert_id", "client_ip", "timestamp", "severity", "window_start", "window_end", "evidence", "raw_log")


def flatten_batches(batches: DataFrame, alerts: str = "alerts") -> DataFrame:
    """One row per alert of a batch; the batch's other columns come along."""
    rest = [c for c in batches.columns if c != alerts]
    return batches.select(*rest, F.explode(alerts).alias("_alert")).select(*rest, "_alert.*")


def identified(alerts: DataFrame, order: str = "arrival") -> DataFrame:
    """Alerts sent without an id get one from what they are, so that a rerun agrees."""
    derived = F.sha2(F.concat_ws("|", F.lit("sent"), "client_id", F.col("track").cast("string"), "attack_type",
                                 F.col("received_at").cast("string"), F.col(order).cast("string")), 256)
    return alerts.withColumn("alert_id", F.coalesce(F.nullif("alert_id", F.lit("")), derived))


def unique_alerts(alerts: DataFrame, order: str = "arrival") -> DataFrame:
    """First arrival of every alert id; alerts without an id are never each other's copies."""
    alerts = identified(alerts, order)
    first = F.min_by(F.struct(*alerts.columns), F.struct("received_at", order)).alias("a")
    return alerts.groupBy("alert_id").agg(first).select("a.*")


def merge_bursts(
    alerts: DataFrame, order: str = "arrival", gap_seconds: float = fv.MERGE_SECONDS,
    chunk_seconds: float = 300.0, fresh: str | None = None,
) -> DataFrame:
    """Alerts of one client, type and track that follow within the gap become one row.

    Counts add up, the highest confidence and the last arrival win, empty rule metadata is
    filled by the first alert that has it; everything else stays as first received. With
    ``fresh``, a Boolean column of the input, the result says whether any alert had it set.
    """
    kept = [c for c in FROM_FIRST if c in alerts.columns]
    fill = [c for c in FILLABLE if c in alerts.columns]
    place = F.struct("received_at", order)
    filled = lambda c: F.min(F.when(F.col(c) != "", F.struct(place.alias("at"), F.col(c).alias("value"))))
    partial = sessions.session_partials(alerts, MERGE_KEYS, "received_at", order, gap_seconds, [
        F.min(place).alias("_first"),
        F.min_by(F.struct(*kept), place).alias("_kept"),
        F.sum(F.greatest(F.coalesce("event_count", F.lit(0)), F.lit(1)).cast("bigint")).alias("event_count"),
        F.max("confidence").alias("confidence"),
        *([F.bool_or(fresh).alias("_fresh")] if fresh else []),
        *[filled(c).alias(f"_{c}") for c in fill],
    ], chunk_seconds)
    merged = sessions.join_partials(partial, MERGE_KEYS, gap_seconds, [
        F.min_by("_kept", "_first").alias("_kept"),
        F.sum("event_count").alias("event_count"), F.max("confidence").alias("confidence"),
        F.max("_end").alias("received_at"),
        *([F.bool_or("_fresh").alias(fresh)] if fresh else []),
        *[F.min(f"_{c}").alias(f"_{c}") for c in fill],
    ])
    return merged.select(
        *MERGE_KEYS, "_kept.*", "received_at", "event_count", "confidence",
        *[F.coalesce(F.col(f"_{c}.value"), F.lit("")).alias(c) for c in fill],
        F.lit("open").alias("status"), *([fresh] if fresh else []),
    )


def merge_into_store(stored: DataFrame, batch: DataFrame, seen: DataFrame, order: str = "arrival",
                     gap_seconds: float = fv.MERGE_SECONDS) -> DataFrame:
    """What a batch of arrivals changes: new rows, and stored rows that grew, under their old id.

    Only rows young enough to be joined are read from the store; a row an analyst has judged grows
    like any other and keeps its status. ``seen`` has the ids of all earlier arrivals, those merged
    into other rows included: without them a resend of a merged alert would count twice.
    """
    new = unique_alerts(batch, order)
    new = new.join(seen.select("alert_id").distinct(), "alert_id", "left_anti")
    oldest = F.coalesce(batch.agg(F.min("received_at")).scalar(), F.lit(float("inf")))
    young = stored.filter(F.col("received_at") >= oldest - gap_seconds)
    columns = [c for c in stored.columns if c in new.columns and c != order]
    # A stored row comes before any arrival of the same time.
    rows = young.select(*columns, F.lit(-1).cast("bigint").alias(order), F.lit(False).alias("is_new")).unionByName(
        new.select(*columns, F.col(order).cast("bigint").alias(order), F.lit(True).alias("is_new")))
    grown = merge_bursts(rows, order, gap_seconds, fresh="is_new").filter("is_new").drop("is_new")
    judged = young.select("alert_id", F.col("status").alias("_status"))
    return grown.join(judged, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def ingest(alerts: DataFrame, order: str = "arrival") -> DataFrame:
    return merge_bursts(unique_alerts(alerts, order), order)


def current_status(alerts: DataFrame, changes: DataFrame, order: str = "arrival") -> DataFrame:
    """Alerts with the latest valid status change; ``changes`` is append-only."""
    latest = (
        changes.filter(F.trim("status").isin(*fv.ALERT_STATES))
        .groupBy("alert_id").agg(F.max_by(F.trim("status"), F.struct("changed_at", order)).alias("_status"))
    )
    base = F.coalesce(F.col("_status"), F.col("status")) if "status" in alerts.columns else F.coalesce(
        F.col("_status"), F.lit("open"))
    return alerts.join(latest, "alert_id", "left").withColumn("status", base).drop("_status")


def search(alerts: DataFrame, track: int | None = None, min_severity: int | None = None,
           rule_id: str | None = None, client_id: str | None = None) -> DataFrame:
    """Optional filters; text matches anywhere, ignoring case, with ``%`` and ``_`` wild."""
    found = alerts
    if track is not None:
        found = found.filter(F.col("track") == track)
    if min_severity is not None:
        found = found.filter(F.col("severity") >= min_severity)
    if rule_id:
        like = f"%{rule_id}%"
        found = found.filter(F.col("rule_id").ilike(like) | F.col("attack_type").ilike(like))
    if client_id:
        found = found.filter(F.col("client_id").ilike(f"%{client_id}%"))
    return found


def page(alerts: DataFrame, limit: int = fv.PAGE_LIMIT, offset: int = 0, tie: str = "alert_id") -> DataFrame:
    return alerts.orderBy(F.desc("received_at"), tie).offset(offset).limit(limit)


def since(alerts: DataFrame, as_of: float, hours: float = fv.STATS_HOURS) -> DataFrame:
    return alerts.filter(F.col("received_at") >= as_of - hours * 3600)


def counts_with_zeros(alerts: DataFrame, column: str, values: range) -> DataFrame:
    """Rows per value, with 0 for the values nobody has; NULL counts as 0."""
    counted = alerts.groupBy(F.coalesce(column, F.lit(0)).cast("int").alias(column)).agg(F.count("*").alias("n"))
    every = F.sequence(F.lit(values.start), F.lit(values.stop - 1))
    zeros = alerts.sparkSession.range(1).select(F.explode(every).alias(column), F.lit(0).cast("bigint").alias("n"))
    return counted.unionByName(zeros).groupBy(column).agg(F.sum("n").alias("alerts"))


def by_severity(alerts: DataFrame) -> DataFrame:
    return counts_with_zeros(alerts, "severity", range(fv.SEVERITY_UNKNOWN, fv.SEVERITY_CRITICAL + 1))


def by_track(alerts: DataFrame) -> DataFrame:
    return counts_with_zeros(alerts, "track", range(fv.TRACK_UNKNOWN, fv.TRACK_NETWORK + 1))


def top_attack_types(alerts: DataFrame, keep: int = fv.TOP_ATTACK_TYPES) -> DataFrame:
    return (
        alerts.filter(F.col("attack_type").isNotNull() & (F.col("attack_type") != ""))
        .groupBy("attack_type").agg(F.count("*").alias("alerts"))
        .orderBy(F.desc("alerts"), "attack_type").limit(keep)
    )


def per_client_tracks(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("client_id").agg(
        F.count_if(F.col("track") == fv.TRACK_HOST).alias("host_alerts"),
        F.count_if(F.col("track") == fv.TRACK_NETWORK).alias("net_alerts"))


def latest_heartbeats(beats: DataFrame, order: str = "beat") -> DataFrame:
    latest = F.max_by(F.struct(*beats.columns), F.struct("last_seen", order)).alias("b")
    return beats.groupBy("client_id").agg(latest).select("b.*")


def liveness(clients: DataFrame, as_of: float, offline_after: float = fv.OFFLINE_AFTER_SECONDS) -> DataFrame:
    """Clients, last seen first, with ``online`` and the whole seconds since then."""
    age = F.lit(float(as_of)) - F.col("last_seen")
    return clients.withColumns({
        "online": age < offline_after, "last_seen_ago": age.cast("bigint"),
    }).orderBy(F.desc("last_seen"), "client_id")


def status(alerts: DataFrame, clients: DataFrame, models: DataFrame, updates: DataFrame, as_of: float) -> DataFrame:
    """One row of totals. Each figure is a scalar subquery of its own table."""
    network = models.filter(F.col("track") == fv.TRACK_NETWORK)
    newest = network.agg(F.max(F.struct("round", "version", "client_count", "updated_at")).alias("m"))
    current = F.coalesce(network.agg(F.max("round")).scalar(), F.lit(0))
    online = F.lit(float(as_of)) - F.col("last_seen") < fv.OFFLINE_AFTER_SECONDS
    part = lambda field: newest.select(F.col(f"m.{field}")).scalar()
    return alerts.sparkSession.range(1).select(
        alerts.agg(F.count("*")).scalar().alias("total_alerts"),
        clients.agg(F.count_if(online)).scalar().alias("online_clients"),
        clients.agg(F.count("*")).scalar().alias("total_clients"),
        part("round").alias("model_round"), part("version").alias("model_version"),
        part("client_count").alias("model_clients"), part("updated_at").alias("model_updated_at"),
        updates.filter(F.col("base_round") >= current).agg(F.count("*")).scalar().alias("pending_updates"),
        F.lit(fv.MIN_CLIENTS).alias("min_clients"),
    )


def union_tracks(host: DataFrame, network: DataFrame) -> DataFrame:
    """Host and network alerts in one table; a column one side lacks is NULL there."""
    return host.unionByName(network, allowMissingColumns=True)
