"""Host detection on a stream.

Rules that look at one event run per micro-batch with the indicator lists read anew, which
is the hot reload. Counting rules keep state per (rule, machine, source, account): events
wait until the watermark passes them, so they are judged in event-time order and the
stream fires exactly where the batch plan does.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nightwarden import fixed_values as fv
from nightwarden.functions import clock
from nightwarden.plans import host_detection, host_rules
from nightwarden.sources import indicators
from nightwarden.sources.indicators import Indicators
from nightwarden.streaming.waiting import Waiting

KEYS = host_detection.COUNTER_KEYS
RECORD = host_detection.EVENT_FIELDS
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
SLICE_US = 10_000_000
_WAITS = {"at_us": "bigint", "log_id": "bigint", "value": "string", "record": "string"}
_COUNTED = "log_id bigint, at_us bigint, window_total bigint, window_distinct bigint, record string"


def single_event_detections(events: DataFrame) -> DataFrame:
    """Stateless rules; works on a stream as it is."""
    return host_detection.event_detections(events)


def batch_detections(read_lists: Callable[[], Indicators]) -> Callable[[DataFrame], DataFrame]:
    """Per micro-batch: stateless and indicator rules with freshly read lists."""
    def run(batch: DataFrame) -> DataFrame:
        found = host_detection.event_detections(batch)
        return found.unionByName(host_detection.indicator_detections(batch, read_lists()))
    return run


class Judge(StatefulProcessor):
    """One key of a counting rule.

    Judged events lie in the state by time slice. A trigger reads the slices that enter the window
    and those that leave it, and the counts of their values; the slices between stay untouched.
    """

    def __init__(self, minimum: dict[str, tuple[int, int]], window_us: int):
        self.minimum, self.window_us = minimum, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, _WAITS, "at_us", SLICE_US)
        # Judged events; an entry is a slice and the trigger that added to it.
        self.judged = handle.getMapState("judged", "slice bigint, part bigint", "at array<bigint>, value array<string>")
        self.present = handle.getMapState("present", "value string", "n bigint")
        # Entries in the window in order, how many events of the first are out again, events and values in the window.
        self.figures = handle.getValueState(
            "figures", "slices array<bigint>, parts array<bigint>, gone bigint, total bigint, uniq bigint, last_at bigint, last_fired bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.waiting.add([pdf[list(_WAITS)].assign(value=pdf["value"].fillna("")) for pdf in rows])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        events = self.waiting.passed(watermark_ms)
        if events is None:
            self._forget(watermark_ms)
            return
        slices, parts, gone, total, uniq, last_at, last_fired = self.figures.get() if self.figures.exists() else ([], [], 0, 0, 0, 0, -1)
        entries, counts, stored = list(zip(slices, parts)), {}, {}
        empty = not entries  # nothing in the window, so nothing in the state to ask for

        def count(value: str, by: int) -> int:
            if value not in counts:
                known = not empty and self.present.containsKey((value,))
                counts[value] = stored[value] = self.present.getValue((value,))[0] if known else 0
            counts[value] += by
            return counts[value]

        events = events.sort_values(["at_us", "log_id"], ignore_index=True)
        fresh: dict[tuple[int, int], tuple[list[int], list[str]]] = {}
        first: tuple[list[int], list[str]] | None = None  # the entry that leaves the window
        min_total, min_distinct = self.minimum[key[0]]
        out = []
        for now, log, value, record in zip(*(events[c].tolist() for c in ("at_us", "log_id", "value", "record"))):
            at = now // SLICE_US
            if not entries or entries[-1] not in fresh or entries[-1][0] != at:
                entries.append((at, entries[-1][1] + 1 if entries and entries[-1][0] == at else 0))
                fresh[entries[-1]] = ([], [])
            fresh[entries[-1]][0].append(now)
            fresh[entries[-1]][1].append(value)
            total += 1
            uniq += bool(value) and count(value, 1) == 1
            while True:
                if first is None:
                    first = fresh.get(entries[0]) or self.judged.getValue(entries[0])
                if gone == len(first[0]):
                    if fresh.pop(entries[0], None) is None:
                        self.judged.removeKey(entries[0])
                    entries.pop(0)
                    first, gone = None, 0
                elif first[0][gone] < now - self.window_us:
                    old = first[1][gone]
                    gone, total = gone + 1, total - 1
                    uniq -= bool(old) and count(old, -1) == 0
                else:
                    break
            last_at = now
            if total >= min_total and uniq >= min_distinct and (last_fired < 0 or now - last_fired >= self.window_us):
                last_fired = now
                out.append((log, now, total, uniq, record))
        for entry, held in fresh.items():
            self.judged.updateValue(entry, held)
        for value, before in stored.items():
            if counts[value] and counts[value] != before:
                self.present.updateValue((value,), (counts[value],))
            elif before and not counts[value]:
                self.present.removeKey((value,))
        self.figures.update(([e[0] for e in entries], [e[1] for e in entries], gone, total, uniq, last_at, last_fired))
        self.handle.registerTimer(max((last_at + 2 * self.window_us) // 1000 + 1, watermark_ms + 1))
        if out:
            result = pd.DataFrame(out, columns=["log_id", "at_us", "window_total", "window_distinct", "record"])
            for name, part in zip(KEYS, key):
                result[name] = part
            yield result[[*KEYS, "log_id", "at_us", "window_total", "window_distinct", "record"]]

    def _forget(self, watermark_ms: int) -> None:
        """A key that has been silent for two windows leaves nothing behind."""
        if self.figures.exists() and self.figures.get()[5] + 2 * self.window_us < watermark_ms * 1000:
            for state in (self.figures, self.judged, self.present):
                state.clear()

    def close(self) -> None:
        pass


def published_detections(spark: SparkSession, path: str) -> Callable[[DataFrame], DataFrame]:
    """Per micro-batch: indicator rules with the lists published at its start, and their version."""
    def run(batch: DataFrame) -> DataFrame:
        version, lists = indicators.current(spark, path)
        return host_detection.indicator_detections(batch, lists).withColumn("lists_version", F.lit(version))
    return run


def threshold_fires(
    events: DataFrame, delay: str = "2 minutes", window_seconds: int = fv.WINDOW_SECONDS, **limits: int
) -> DataFrame:
    """Firing events of the counting rules: key, log id, time, counts and the event as JSON.

    An event's text waits in the state until the event is judged; what stays to fill the window
    is its time and value, by time slice, and a count for each value in the window.
    """
    rules = host_rules.threshold_rules(**limits)
    needed = sorted({f for r in rules for f in r.fields})
    record = F.to_json(F.struct(*RECORD, F.map_filter("data", lambda k, _: k.isin(*needed)).alias("data")), MICROS)
    minimum = {r.rule_id: (r.min_total, r.min_distinct) for r in rules}
    window_us = window_seconds * clock.MICROS
    ids = sorted({i for r in rules for i in r.event_ids})
    watched = F.filter(F.array(*[r.watched() for r in rules]), lambda w: w.isNotNull())
    rows = (
        events.withWatermark("event_time", delay)
        .filter(F.col("event_id").isin(*ids))
        .select("event_time", "computer", "log_id", record.alias("record"), F.explode(watched).alias("w"))
        .select("event_time", "computer", "log_id", "record", "w.*", clock.to_micros(F.col("event_time")).alias("at_us"))
    )

    out = ", ".join(f"{k} string" for k in KEYS) + ", " + _COUNTED
    return rows.groupBy(*KEYS).transformWithStateInPandas(Judge(minimum, window_us), out, "append", "eventTime")


def threshold_detections(events: DataFrame, **settings) -> DataFrame:
    """Detections of the counting rules on a stream, in the form of the batch plan."""
    rules = host_rules.threshold_rules(**{k: v for k, v in settings.items() if k not in ("delay", "window_seconds")})
    fires = threshold_fires(events, **settings)
    kinds = ", ".join(f"{name} {kind}" for name, kind in events.dtypes if name in RECORD)
    fired = fires.withColumn("r", F.from_json("record", f"{kinds}, data MAP<STRING, STRING>", MICROS)).select(
        *[F.col(f"r.{name}").alias(name) for name in (*RECORD, "data")], *[k for k in KEYS if k != "computer"], "window_total", "window_distinct")
    described = F.coalesce(*[F.when(F.col("rule") == r.rule_id, r.detection()) for r in rules])
    return fired.select(*RECORD, described.alias("d")).select(*RECORD, "d.*")


def write_batches(stream: DataFrame, path: str, checkpoint: str, transform=None, prepare=None,
                  trigger: dict | None = None):
    """Write every micro-batch to its own folder; a replayed batch replaces itself.

    ``prepare`` runs once per batch and its result is kept while ``transform`` reads it. A
    ``transform`` that needs two arguments also gets the number of the batch.
    """
    numbered = transform is not None and sum(
        p.default is p.empty for p in inspect.signature(transform).parameters.values()) > 1

    def write(batch: DataFrame, batch_id: int) -> None:
        prepared = (prepare(batch) if prepare else batch).persist()
        try:
            result = transform(prepared, *([batch_id] if numbered else [])) if transform else prepared
            result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            prepared.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
    )
