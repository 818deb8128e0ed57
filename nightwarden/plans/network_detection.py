"""Model flow rows to network alerts.

A scoring batch is one client's flows of one time slice. Batch figures are aggregated with
partial aggregation; only flagged flows are ever ranked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType

from nightwarden import fixed_values as fv
from nightwarden.functions import clock
from nightwarden.functions.numbers import finite_or_zero, no_number, number_or_zero, ordered, protocol_number, severity
from nightwarden.session import checkpointed

BATCH = ["client_id", "batch_start"]

# Advice shown with an alert, by attack type.
ADVICE = {
    "Port Scan": ("Block the source and close ports it found open.", "Somebody maps reachable services."),
    "UDP Flood": ("Rate-limit the source upstream.", "One-way datagrams exhaust the link."),
    "DDoS / Volumetric Flood": ("Ask the provider for scrubbing.", "Many small packets saturate the link."),
    "DoS – HTTP Flood": ("Limit request rates at the web tier.", "A web service is being overloaded."),
    "SSH Brute Force": ("Use keys only and block the source.", "Repeated short logon attempts on SSH."),
    "FTP Brute Force": ("Replace FTP and block the source.", "Repeated short logon attempts on FTP."),
    "Web Attack": ("Read the web log of the source and patch.", "Requests look like an exploit attempt."),
    "Botnet C2 Beaconing": ("Check the peer and isolate the host.", "Regular small exchanges look like beacons."),
    fv.GENERIC_ATTACK: ("Compare the evidence with expected traffic.", "The model finds this flow unlike benign ones."),
}


# --- feature preparation ----------------------------------------------------------

def trimmed_names(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{name}`").alias(name.strip()) for name in rows.columns])


def prepare_features(rows: DataFrame, features: tuple[str, ...] = fv.MODEL_FEATURES) -> DataFrame:
    """Features as finite numbers: missing columns, bad text, NaN and infinities become 0."""
    rows = trimmed_names(rows)
    prepared = {
        name: finite_or_zero(F.col(f"`{name}`")) if name in rows.columns else F.lit(0.0) for name in features
    }
    if "Protocol" in rows.columns:
        prepared["Protocol"] = protocol_number(F.col("Protocol"))
    return rows.withColumns(prepared)


def without_skip_ports(rows: DataFrame) -> DataFrame:
    """Drop flows to ports whose normal traffic looks like an attack; no port is kept."""
    ports, column = [float(p) for p in fv.SKIP_PORTS], F.col("DestinationPort")
    if isinstance(rows.schema["DestinationPort"].dataType, NumericType):  # plain, so that the scan sees it
        return rows.filter(column.isNull() | ~column.isin(*ports))
    return rows.filter(~finite_or_zero(column).isin(*ports))


def with_signal(rows: DataFrame, features: tuple[str, ...] = fv.MODEL_FEATURES) -> DataFrame:
    """Drop rows in which nothing but the port (or protocol) says anything."""
    signal = [F.col(f) for f in features if f not in ("DestinationPort", "Protocol")]
    return rows.filter(F.exists(F.array(*signal), lambda x: x != 0))


def batch_of(rows: DataFrame, seconds: int = fv.SCORING_BATCH_SECONDS, as_of: float | None = None) -> DataFrame:
    """Add the start of the scoring batch and ``as_of``, the time of ingest.

    Flows without a start belong to the batch of their ingest; without that, to the batch NULL.
    """
    ingest = F.lit(None if as_of is None else float(as_of)).cast("double")
    slice_ = F.floor(F.coalesce(F.col("FlowStartTime"), ingest) / F.lit(float(seconds))).cast("bigint")
    return rows.withColumns({"batch_start": slice_ * seconds, "as_of": ingest})


def scoring_rows(rows: DataFrame, seconds: int = fv.SCORING_BATCH_SECONDS,
                 features: tuple[str, ...] = fv.MODEL_FEATURES, as_of: float | None = None) -> DataFrame:
    """Rows worth scoring with the prepared feature vector ``x``; raw columns stay as read."""
    rows = trimmed_names(rows)
    absent = [f for f in features if f not in rows.columns]
    complete = rows.withColumns({f: F.lit(None).cast("double") for f in absent}) if absent else rows
    prepared = F.array(*[finite_or_zero(F.col(f)) for f in features])
    silent = F.array(*[F.lit(f in ("DestinationPort", "Protocol")) for f in features])
    says = lambda x: F.exists(F.arrays_zip(x.alias("v"), silent.alias("s")), lambda e: ~e["s"] & (e["v"] != 0))
    if features[0] == "DestinationPort" and "Protocol" not in features:
        says = lambda x: F.exists(F.slice(x, 2, len(features) - 1), lambda v: v != 0)
    # Exploding the kept vector instead of filtering on 37 derived columns: the optimizer
    # infers constraints from filters, and their number doubles with every such column.
    # One array keeps the row narrow enough for generated code, too.
    vectors = without_skip_ports(complete).withColumn("_x", prepared)
    kept = F.filter(F.array("_x"), says)
    return batch_of(vectors.select(*complete.columns, F.explode(kept).alias("x")), seconds, as_of)


# --- model ------------------------------------------------------------------------

@dataclass
class Model:
    """Network with one logistic output: the probability of class 1 (benign)."""

    coefs: list[np.ndarray]
    intercepts: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    activation: str = "relu"
    classes: tuple[int, ...] = (fv.LABEL_ATTACK, fv.LABEL_BENIGN)

    def validated(self, features: tuple[str, ...] = fv.MODEL_FEATURES) -> "Model":
        if tuple(self.classes) != (fv.LABEL_ATTACK, fv.LABEL_BENIGN):
            raise ValueError(f"class order is {self.classes}, expected attack then benign")
        if self.coefs[0].shape[0] != len(features):
            raise ValueError(f"model takes {self.coefs[0].shape[0]} features, the list has {len(features)}")
        return self

    def attack_probability(self, x: np.ndarray) -> np.ndarray:
        hidden = (x - self.mean) / self.scale
        act = {"relu": lambda v: np.maximum(v, 0), "tanh": np.tanh,
               "logistic": lambda v: 1 / (1 + np.exp(-v)), "identity": lambda v: v}[self.activation]
        for weights, bias in zip(self.coefs[:-1], self.intercepts[:-1]):
            hidden = act(hidden @ weights + bias)
        z = (hidden @ self.coefs[-1] + self.intercepts[-1])[:, 0]
        return 1 / (1 + np.exp(np.clip(z, -500, 500)))


def standardised(rows: DataFrame, mean: list[float], scale: list[float],
                 features: tuple[str, ...] = fv.MODEL_FEATURES) -> DataFrame:
    """Features as (x - mean) / scale with stored vectors."""
    return rows.withColumns({
        f: (F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, mean, scale)
    })


def scored(rows: DataFrame, model: Model, features: tuple[str, ...] = fv.MODEL_FEATURES) -> DataFrame:
    """Add ``p_attack``. Scoring is a matrix product per Arrow batch of vectors ``x``."""
    model = model.validated(features)
    width = len(features)

    @F.arrow_udf("double")
    def probability(x: pa.Array) -> pa.Array:
        return pa.array(model.attack_probability(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)))

    return rows.withColumn("p_attack", probability("x"))


# --- labels and metadata ----------------------------------------------------------

def attack_type() -> Column:
    """Attack category of a flagged flow, most specific first.

    NULL and empty cells count as 0 and NaN meets no limit; a flow with other text for a figure gets
    the generic type.
    """
    value = lambda name: number_or_zero(F.col(name))
    above = lambda name, limit: ordered(value(name), lambda v: v > limit)
    below = lambda name, limit: value(name) < limit  # noqa: E731  false for NaN, which Spark orders last
    port = lambda *ports: value("DestinationPort").isin(*[float(p) for p in ports])
    answered = above("BwdPacketsPerSec", 0)
    logon = below("AveragePacketSize", fv.LOGON_PACKET) & below("TotalFwdPackets", fv.LOGON_PACKETS)
    used = ("FlowBytesPerSec", "AveragePacketSize", "FlowPacketsPerSec", "BwdPacketsPerSec", "FlowDurationMs", "TotalFwdPackets",
            "MinPacketLength", "MaxPacketLength", "DestinationPort", "InitWinBytesFwd", "FwdIATStd", "BwdIATMax")
    return (
        F.when(reduce(or_, (no_number(F.col(name)) for name in used)), fv.GENERIC_ATTACK)
        .when(above("FlowBytesPerSec", fv.VOLUME_BYTES_PER_SEC) & below("AveragePacketSize", fv.SMALL_PACKET), "DDoS / Volumetric Flood")
        .when(above("FlowPacketsPerSec", fv.FLOOD_PACKETS_PER_SEC) & ~answered & below("AveragePacketSize", fv.SMALL_PACKET), "UDP Flood")
        .when(below("FlowDurationMs", fv.SCAN_DURATION_US) & (value("TotalFwdPackets") <= fv.SCAN_MAX_PACKETS) & ~answered
              & below("MinPacketLength", fv.SMALL_PACKET), "Port Scan")
        .when(port(fv.SSH_PORT) & logon, "SSH Brute Force")
        .when(port(fv.FTP_PORT) & logon, "FTP Brute Force")
        .when(port(*fv.HTTP_PORTS) & above("FlowBytesPerSec", fv.HTTP_BYTES_PER_SEC) & answered, "DoS – HTTP Flood")
        .when(port(*fv.WEB_PORTS) & ordered(value("InitWinBytesFwd"), lambda v: v >= fv.WEB_WINDOW)
              & above("TotalFwdPackets", fv.WEB_MIN_PACKETS) & above("FlowBytesPerSec", fv.WEB_BYTES_PER_SEC), "Web Attack")
        .when(above("FlowDurationMs", fv.BEACON_DURATION_US) & below("AveragePacketSize", fv.BEACON_PACKET)
              & below("FwdIATStd", fv.BEACON_FWD_SPREAD) & below("BwdIATMax", fv.BEACON_BWD_GAP) & answered, "Botnet C2 Beaconing")
        .otherwise(fv.GENERIC_ATTACK)
    )


def metadata(spark: SparkSession) -> DataFrame:
    """Attack type to rule id, technique, tactic and advice; a fixed handful of rows."""
    entries = [
        F.struct(*[F.lit(x).alias(n) for n, x in zip(
            ("attack", "rule_id", "mitre_id", "mitre_tactic", "suggestion", "risk_note"),
            (name, *fixed, *ADVICE[name]))])
        for name, fixed in fv.NETWORK_ATTACKS.items()
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def with_metadata(rows: DataFrame, attack: str = "attack_type") -> DataFrame:
    """Add rule id, technique, tactic and advice; unknown types get the generic entry."""
    entries = metadata(rows.sparkSession)
    known = F.when(F.col(attack).isin(*fv.NETWORK_ATTACKS), F.col(attack)).otherwise(fv.GENERIC_ATTACK)
    return rows.withColumn("attack", known).join(F.broadcast(entries), "attack").drop("attack")


def evidence() -> Column:
    return F.to_json(F.struct(*[F.round(F.col(f), 4).alias(f) for f in fv.EVIDENCE_FEATURES]))


def batch_time(rows: DataFrame) -> Column:
    """Alert time of a batch: its latest flow start above 0, else the time of ingest."""
    latest = F.max("FlowStartTime")
    ingest = F.max("as_of") if "as_of" in rows.columns else F.lit(None).cast("double")
    return F.when(latest > 0, latest).otherwise(ingest).alias("batch_time")


def batch_times(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BATCH).agg(batch_time(rows))


# --- alerts -----------------------------------------------------------------------

ALERT_FIELDS = (
    "alert_id", "client_id", "batch_start", "timestamp", "track", "attack_type", "severity", "confidence",
    "window_start", "window_end", "event_count", "evidence", "rule_id", "mitre_id", "mitre_tactic",
    "suggestion", "risk_note",
)


def flagged(rows: DataFrame, threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    return rows.filter(F.col("p_attack") >= threshold).withColumn("attack_type", attack_type())


def flagged_figures(rows: DataFrame, threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """Batches with flagged flows: their number, confidence, span, and the batch time."""
    hit = F.col("p_attack") >= threshold
    confidence, start = F.when(hit, F.col("p_attack")), F.when(hit, F.col("FlowStartTime"))
    return rows.groupBy(*BATCH).agg(
        F.count_if(hit).alias("flow_count"), F.avg(confidence).alias("mean_conf"), F.max(confidence).alias("max_conf"),
        F.min(start).alias("first_start"), F.max(start).alias("last_start"), batch_time(rows),
    ).filter("flow_count > 0")


def _same_batch(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the batch, the NULL batch included."""
    renamed = right.withColumnsRenamed({name: f"_{name}" for name in BATCH})
    match = (F.col("client_id") == F.col("_client_id")) & F.col("batch_start").eqNullSafe(F.col("_batch_start"))
    return left.join(renamed, match, how).drop("_client_id", "_batch_start")


def flow_alerts(rows: DataFrame, flow_id: str = "flow_no", threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """One alert per flagged flow in batches of at most ``BURST_MIN_FLOWS`` flagged flows."""
    quiet = flagged_figures(rows, threshold).filter(F.col("flow_count") <= fv.BURST_MIN_FLOWS)
    timed = _same_batch(flagged(rows, threshold), quiet)
    stamp = clock.iso_seconds(F.col("batch_time"))
    return with_metadata(timed).withColumns({
        "alert_id": F.sha2(F.concat_ws("|", F.lit("flow"), "client_id", F.col(flow_id).cast("string")), 256),
        "timestamp": stamp, "window_start": stamp, "window_end": stamp,
        "track": F.lit(fv.TRACK_NETWORK), "confidence": F.col("p_attack"),
        "severity": severity(F.col("p_attack")), "event_count": F.lit(1), "evidence": evidence(),
    }).select(*ALERT_FIELDS)


def top_ports(flags: DataFrame, keep: int = fv.TOP_PORTS) -> DataFrame:
    """Most frequent destination ports per batch, the lower port first on ties; no port is no row."""
    number = F.col("DestinationPort").try_cast("double")
    port = F.when(~F.isnan(number), number.try_cast("int"))
    counts = flags.filter(port.isNotNull()).groupBy(*BATCH, port.alias("port")).agg(F.count("*").alias("flows"))
    rank = F.row_number().over(Window.partitionBy(*BATCH).orderBy(F.desc("flows"), "port"))
    return counts.withColumn("place", rank).filter(F.col("place") <= keep)


def dominant_types(flags: DataFrame, order: str = "flow_no") -> DataFrame:
    """Most frequent attack type among all flagged flows; the first seen wins ties."""
    counts = flags.groupBy(*BATCH, "attack_type").agg(
        F.count("*").alias("n"), F.min(F.struct("FlowStartTime", order)).alias("seen"))
    return counts.groupBy(*BATCH).agg(F.min_by("attack_type", F.struct(-F.col("n"), F.col("seen"))).alias("attack_type"))


#: What alerts read of scored rows beside the order column.
READ = tuple(dict.fromkeys((
    *BATCH, "as_of", "FlowStartTime", "p_attack", *fv.EVIDENCE_FEATURES, "FlowPacketsPerSec", "BwdPacketsPerSec", "FlowDurationMs",
    "TotalFwdPackets", "MinPacketLength", "MaxPacketLength", "InitWinBytesFwd", "FwdIATStd", "FINFlagCount", "PSHFlagCount", "ACKFlagCount")))


def _once(rows: DataFrame, order: str) -> DataFrame:
    """The scored rows, written: scoring runs once however many figures follow."""
    return checkpointed(rows.select(*[c for c in dict.fromkeys((*READ, order)) if c in rows.columns]))


def burst_summaries(rows: DataFrame, order: str = "flow_no", threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    """One row per batch with more flagged flows than a burst allows."""
    return _burst_summaries(_once(rows, order), order, threshold)


def _burst_summaries(rows: DataFrame, order: str, threshold: float) -> DataFrame:
    flags = flagged(rows, threshold)
    totals = flagged_figures(rows, threshold).filter(F.col("flow_count") > fv.BURST_MIN_FLOWS)
    ports = top_ports(flags).groupBy(*BATCH).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "port", "flows"))),
        lambda p: F.struct(p["port"], p["flows"]))).alias("top_ports"))
    return _same_batch(_same_batch(totals, dominant_types(flags, order)), ports, "left")


def burst_alerts(rows: DataFrame, order: str = "flow_no", threshold: float = fv.ALERT_THRESHOLD) -> DataFrame:
    return _burst_alerts(_once(rows, order), order, threshold)


def _burst_alerts(rows: DataFrame, order: str, threshold: float) -> DataFrame:
    stamp = clock.iso_seconds(F.col("batch_time"))
    return with_metadata(_burst_summaries(rows, order, threshold)).withColumns({
        "alert_id": F.sha2(F.concat_ws("|", F.lit("burst"), "client_id", F.col("batch_start").cast("string")), 256),
        "timestamp": stamp,
        "window_start": F.coalesce(clock.iso_seconds(F.col("first_start")), stamp),
        "window_end": F.coalesce(clock.iso_seconds(F.col("last_start")), stamp),
        "track": F.lit(fv.TRACK_NETWORK), "confidence": F.col("mean_conf"),
        "severity": severity(F.col("mean_conf")), "event_count": F.col("flow_count").cast("int"),
        "evidence": F.to_json(F.struct(
            "flow_count", F.round("mean_conf", 4).alias("mean_conf"), F.round("max_conf", 4).alias("max_conf"),
            "top_ports", F.lit(fv.METHOD_BURST).alias("method"))),
    }).select(*ALERT_FIELDS)


# --- batch rules ------------------------------------------------------------------

def scan_like() -> Column:
    c = F.col
    return ((c("TotalFwdPackets") <= 2) & (c("AveragePacketSize") < 100)
            & (c("FINFlagCount") == 0) & (c("PSHFlagCount") == 0))


def flood_like() -> Column:
    c = F.col
    return ((c("ACKFlagCount") == 0) & (c("FINFlagCount") == 0) & (c("PSHFlagCount") == 0)
            & ordered(c("FlowBytesPerSec"), lambda x: x > 0) & (c("BwdPacketsPerSec") == 0)
            & ordered(c("TotalFwdPackets"), lambda x: x > 2)
            & ~F.coalesce(c("DestinationPort"), F.lit(-1.0)).isin(*[float(p) for p in fv.FLOOD_EXCLUDED_PORTS]))


def batch_rule_counts(rows: DataFrame) -> DataFrame:
    """Figures both batch rules need, one pass per batch."""
    return rows.groupBy(*BATCH).agg(
        F.count_if(scan_like()).alias("scan_flows"),
        F.count_distinct(F.when(scan_like(), F.col("DestinationPort"))).alias("scan_ports"),
        F.count_if(flood_like()).alias("flood_flows"), batch_time(rows),
    )


def batch_rule_hits(rows: DataFrame, scan_flows: int = fv.PORTSCAN_MIN_FLOWS,
                    scan_ports: int = fv.PORTSCAN_MIN_PORTS, flood_flows: int = fv.FLOOD_MIN_FLOWS) -> DataFrame:
    """Batches that meet a rule: attack type, flow count and, for a scan, distinct ports."""
    c = F.col
    scan = F.when((c("scan_flows") >= scan_flows) & (c("scan_ports") >= scan_ports), F.struct(
        F.lit("Port Scan").alias("attack_type"), c("scan_flows").alias("flow_count"),
        c("scan_ports").alias("port_count")))
    flood = F.when(c("flood_flows") >= flood_flows, F.struct(
        F.lit("UDP Flood").alias("attack_type"), c("flood_flows").alias("flow_count"),
        F.lit(None).cast("bigint").alias("port_count")))
    hits = F.filter(F.array(scan, flood), lambda h: h.isNotNull())
    return batch_rule_counts(rows).select(*BATCH, "batch_time", F.explode(hits).alias("h")).select(
        *BATCH, "batch_time", "h.*")


def batch_rule_alerts(rows: DataFrame, **limits: int) -> DataFrame:
    stamp = clock.iso_seconds(F.col("batch_time"))
    return with_metadata(batch_rule_hits(rows, **limits)).withColumns({
        "alert_id": F.sha2(F.concat_ws("|", F.lit("batch"), "rule_id", "client_id",
                                       F.col("batch_start").cast("string")), 256),
        "timestamp": stamp, "window_start": stamp, "window_end": stamp,
        "track": F.lit(fv.TRACK_NETWORK), "confidence": F.lit(fv.BATCH_RULE_CONFIDENCE),
        "severity": F.lit(fv.SEVERITY_HIGH), "event_count": F.col("flow_count").cast("int"),
        "evidence": F.to_json(F.struct(F.lit(fv.METHOD_RULE).alias("method"), "flow_count", "port_count")),
    }).select(*ALERT_FIELDS)


def network_alerts(rows: DataFrame, order: str = "flow_no") -> DataFrame:
    """All alerts of scored rows: single flows, bursts, batch rules."""
    rows = _once(rows, order)
    bursts = _burst_alerts(rows, order, fv.ALERT_THRESHOLD)
    return flow_alerts(rows, order).unionByName(bursts).unionByName(batch_rule_alerts(rows))


def batch_counters(rows: DataFrame, threshold: float = fv.ALERT_THRESHOLD, **limits: int) -> DataFrame:
    """Rows read, attacks (flagged flows and rule hits) and benign rows per batch."""
    read = rows.groupBy(*BATCH).agg(
        F.count("*").alias("rows_read"), F.count_if(F.col("p_attack") >= threshold).alias("flagged"))
    rule_hits = batch_rule_hits(rows, **limits).groupBy(*BATCH).agg(F.count("*").alias("rule_hits"))
    return _same_batch(read, rule_hits, "left").select(
        *BATCH, "rows_read",
        (F.col("flagged") + F.coalesce("rule_hits", F.lit(0))).alias("attacks"),
        (F.col("rows_read") - F.col("flagged")).alias("benign"))


# --- diagnostics ------------------------------------------------------------------

def score_histogram(rows: DataFrame, cuts: tuple[float, ...] = fv.SCORE_CUTS) -> DataFrame:
    """Rows scored at or above each cut."""
    counts = rows.agg(*[F.count_if(F.col("p_attack") >= cut).alias(f"n{i}") for i, cut in enumerate(cuts)])
    entries = F.array(*[F.struct(F.lit(cut).alias("cut"), F.col(f"n{i}").alias("rows")) for i, cut in enumerate(cuts)])
    return counts.select(F.inline(entries))


def column_profile(rows: DataFrame, names: tuple[str, ...] = fv.PROFILE_FEATURES) -> DataFrame:
    """Presence, mean and maximum of chosen features."""
    present = [n for n in names if n in rows.columns]
    figures = rows.agg(*[f(n).cast("double").alias(f"{f.__name__}_{n}") for n in present for f in (F.avg, F.max)])
    entry = lambda n: F.struct(
        F.lit(n).alias("feature"), F.lit(n in present).alias("present"),
        (F.col(f"avg_{n}") if n in present else F.lit(None).cast("double")).alias("mean"),
        (F.col(f"max_{n}") if n in present else F.lit(None).cast("double")).alias("max"))
    return figures.select(F.inline(F.array(*[entry(n) for n in names])))


def top_scored(rows: DataFrame, order: str = "flow_no", keep: int = 15) -> DataFrame:
    return rows.orderBy(F.desc("p_attack"), order).limit(keep)


def short_flows(rows: DataFrame, order: str = "flow_no", shorter_than: float = 1000, keep: int = 10) -> DataFrame:
    return rows.filter(F.col("FlowDurationMs") < shorter_than).orderBy(order).limit(keep)
