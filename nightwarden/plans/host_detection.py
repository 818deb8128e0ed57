"""Host events to detections to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightwarden import fixed_values as fv
from nightwarden.functions import clock, numbers, text
from nightwarden.operators import anchors, matching, sliding
from nightwarden.plans import host_rules
from nightwarden.session import checkpointed, if_small
from nightwarden.sources.indicators import Indicators

DETECTION_FIELDS = (
    "rule_id", "attack_type", "confidence", "mitre_id", "mitre_tactic", "suggestion",
    "risk_note", "evidence", "event_count",
)
EVENT_FIELDS = ("log_id", "computer", "event_id", "event_time", "raw_xml")


def _selected(rules, only: str | None):
    return [r for r in rules if only in (None, r.rule_id)]


def _apply_event_rules(events: DataFrame, rules: list[host_rules.EventRule]) -> DataFrame:
    """All rules in one pass; an event yields one row per rule it meets."""
    ids = sorted({i for rule in rules for i in rule.event_ids})
    hits = F.filter(F.array(*[rule.matched() for rule in rules]), lambda d: d.isNotNull())
    return (
        events.filter(F.col("event_id").isin(*ids))
        .select(*EVENT_FIELDS, F.explode(hits).alias("d"))
        .select(*EVENT_FIELDS, "d.*")
    )


def event_detections(events: DataFrame, only: str | None = None) -> DataFrame:
    return _apply_event_rules(events, _selected(host_rules.event_rules(), only))


def indicator_detections(events: DataFrame, indicators: Indicators, only: str | None = None) -> DataFrame:
    rules = _selected(host_rules.indicator_rules(), only)
    matched = {
        "ioc_domain_match": lambda e: matching.match_domains(
            e.withColumn("_f", text.field("QueryName")), "_f", indicators.domains, host_rules.DOMAIN_HIT),
        "ioc_ip_connection": lambda e: matching.match_addresses(
            e.withColumn("_f", text.field("DestAddress")), "_f", indicators.addresses, host_rules.ADDRESS_HIT),
        "ioc_process_name": lambda e: matching.match_process_names(
            e.withColumn("_f", text.field("NewProcessName")), "_f", indicators.process_names,
            host_rules.NAME_HIT),
        "ioc_process_chain": lambda e: matching.match_process_chains(
            e.withColumn("_f", text.field("ParentProcessName"))
            .withColumn("_g", text.field("NewProcessName")),
            "_f", "_g", indicators.process_chains, host_rules.CHAIN_HIT),
    }
    parts = [
        _apply_event_rules(
            matched[rule.rule_id](events.filter(F.col("event_id").isin(*rule.event_ids)))
            .filter(rule.condition),
            [rule],
        )
        for rule in rules
    ]
    return _union(parts)


COUNTER_KEYS = ["rule", "computer", "source", "account"]


def threshold_counts(
    events: DataFrame, rules: list[host_rules.ThresholdRule],
    window_seconds: int = fv.WINDOW_SECONDS,
) -> DataFrame:
    """Sliding counts of every watched event; all rules share one shuffle."""
    ids = sorted({i for rule in rules for i in rule.event_ids})
    needed = sorted({f for rule in rules for f in rule.fields})
    watched = F.filter(F.array(*[rule.watched() for rule in rules]), lambda w: w.isNotNull())
    rows = (
        events.filter(F.col("event_id").isin(*ids))
        .select(
            "log_id", "computer", "event_id", "event_time",
            F.map_filter("data", lambda k, _: k.isin(*needed)).alias("data"),
            clock.to_micros(F.col("event_time")).alias("at_us"),
            F.explode(watched).alias("w"),
        )
        .select("*", "w.*").drop("w")
    )
    return sliding.sliding_counts(
        rows, COUNTER_KEYS, "at_us", "log_id", F.col("value"),
        window_us=window_seconds * clock.MICROS,
    )


def threshold_hits(counted: DataFrame, rules: list[host_rules.ThresholdRule]) -> DataFrame:
    reached = F.lit(False)
    for rule in rules:
        reached = reached | rule.reached()
    return counted.filter(reached)


def cooled_down(hits: DataFrame, window_seconds: int = fv.WINDOW_SECONDS) -> DataFrame:
    """First hit per key, then the first one at least a window after the last kept."""
    return anchors.anchor_rows(
        hits, COUNTER_KEYS, "at_us", "log_id", window_seconds * clock.MICROS,
        bound_included=False, costly_input=True,
    ).filter("is_anchor")


def threshold_detections(
    events: DataFrame, only: str | None = None, window_seconds: int = fv.WINDOW_SECONDS, **limits: int
) -> DataFrame:
    """Detections of the counting rules.

    Counting and cool-down carry a slim record; the raw text of the few events that fire
    is fetched afterwards by (computer, log_id), which identifies an event. The fired events
    are written and counted: if few, they are sent to where the texts are, and only their
    texts are moved.
    """
    rules = _selected(host_rules.threshold_rules(**limits), only)
    record = [f for f in EVENT_FIELDS if f != "raw_xml"]
    hits = threshold_hits(threshold_counts(events, rules, window_seconds), rules)
    fired = cooled_down(
        hits.select(*record, *[k for k in COUNTER_KEYS if k != "computer"], "at_us", "data",
                    "window_total", "window_distinct"),
        window_seconds,
    )
    described = F.coalesce(*[F.when(F.col("rule") == r.rule_id, r.detection()) for r in rules])
    found = fired.select(*record, described.alias("d")).select(*record, "d.*")
    ids = sorted({i for rule in rules for i in rule.event_ids})
    raw = events.filter(F.col("event_id").isin(*ids)).select("computer", "log_id", "raw_xml")
    found = checkpointed(found)
    texts = raw.join(if_small(found.select("computer", "log_id").distinct()), ["computer", "log_id"], "left_semi").dropDuplicates(["computer", "log_id"])
    return found.join(texts, ["computer", "log_id"], "left").select(*EVENT_FIELDS, *DETECTION_FIELDS)


def detections(events: DataFrame, indicators: Indicators, **limits: int) -> DataFrame:
    """Everything the registry finds."""
    return _union([
        event_detections(events), threshold_detections(events, **limits),
        indicator_detections(events, indicators),
    ])


def alerts(found: DataFrame, detected_at: Column, client_ip: Column | None = None) -> DataFrame:
    """Alert rows. The id is derived from rule and log record, so reruns agree."""
    return found.select(
        F.sha2(F.concat_ws("|", "rule_id", "computer", F.col("log_id").cast("string")), 256).alias("alert_id"),
        F.col("computer").alias("client_id"),
        (client_ip if client_ip is not None else F.lit("0.0.0.0")).alias("client_ip"),
        detected_at.cast("string").alias("timestamp"),
        F.lit(fv.TRACK_HOST).alias("track"),
        "attack_type",
        numbers.severity(F.col("confidence")).alias("severity"),
        "confidence",
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("window_start"),
        detected_at.cast("string").alias("window_end"),
        "event_count", "evidence", "rule_id", "mitre_id", "mitre_tactic", "suggestion", "risk_note",
        text.text_or_empty(F.col("raw_xml")).alias("raw_log"),
        F.lit(None).cast("array<struct<label:string,confidence:double>>").alias("predictions"),
    )


def counters(found: DataFrame) -> DataFrame:
    """Indicator hits against rule hits, per machine."""
    indicator = F.startswith("rule_id", F.lit("ioc_"))
    return found.groupBy("computer").agg(
        F.count_if(indicator).alias("ioc_matches"), F.count_if(~indicator).alias("rule_hits"))


def missing_command_lines(events: DataFrame) -> DataFrame:
    """Process creations without a command line, per machine."""
    blank = text.stripped(text.text_or_empty(text.field("CommandLine"))) == ""
    return events.filter("event_id = 4688").groupBy("computer").agg(
        F.count_if(blank).alias("cmdline_missing"), F.count("*").alias("process_creations"))


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
