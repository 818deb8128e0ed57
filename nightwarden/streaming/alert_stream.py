"""Alert ingest on a stream: duplicates out, bursts merged by session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nightwarden import fixed_values as fv
from nightwarden.plans.alert_store import FILLABLE, FROM_FIRST, MERGE_KEYS, identified


#: Alert ids share so many states; a state holds the ids of one delay.
ID_BUCKETS = 128


class FirstSent(StatefulProcessor):
    """The first alert of every id of a bucket, by time and order whatever the order rows arrive in."""

    def __init__(self, columns: list[str], order: str, delay_ms: int):
        self.columns, self.order, self.delay_ms = columns, order, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "ids array<string>, until_ms array<bigint>")

    def _known(self, watermark_ms: int) -> dict[str, int]:
        held = zip(*self.known.get()) if self.known.exists() else ()
        return {i: until for i, until in held if until > watermark_ms}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        known = self._known(watermark_ms)
        sent = pd.concat(rows).sort_values(["received_at", self.order], kind="stable").drop_duplicates("alert_id")
        new = sent[~sent["alert_id"].isin(list(known))]
        if len(new):
            known |= zip(new["alert_id"], (new["received_at"] * 1000).astype("int64") + 1 + self.delay_ms)
            self.known.update((list(known), list(known.values())))
            self.handle.registerTimer(max(*known.values(), watermark_ms + 1))
            yield new[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._known(timerValues.getCurrentWatermarkInMs()):
            self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_sent(alerts: DataFrame, order: str, delay: str) -> DataFrame:
    """Alerts with a watermark on ``event_time``, each id once within the delay."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in alerts.dtypes)
    delay_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    bucket = F.pmod(F.xxhash64("alert_id"), F.lit(ID_BUCKETS)).alias("bucket")
    return alerts.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        FirstSent(alerts.columns, order, delay_ms), schema, "append", "eventTime", eventTimeColumnName="event_time")


def merged_bursts(alerts: DataFrame, order: str = "arrival", gap_seconds: int = fv.MERGE_SECONDS,
                  delay: str = "5 minutes") -> DataFrame:
    """Stream form of the burst merge. A session closes when the watermark passes its end."""
    kept = [c for c in FROM_FIRST if c in alerts.columns]
    fill = [c for c in FILLABLE if c in alerts.columns]
    place = F.struct("received_at", order)
    timed = identified(alerts, order).withColumn("event_time", F.timestamp_micros(F.round(F.col("received_at") * 1e6).cast("bigint")))
    unique = first_sent(timed.withWatermark("event_time", delay), order, delay)
    # The gap itself still merges, hence the extra microsecond.
    session = F.session_window("event_time", f"{gap_seconds} seconds 1 microsecond")
    return unique.groupBy(*MERGE_KEYS, session.alias("session")).agg(
        F.min_by(F.struct(*kept), place).alias("first"),
        F.sum(F.greatest(F.coalesce("event_count", F.lit(0)), F.lit(1)).cast("bigint")).alias("event_count"),
        F.max("confidence").alias("confidence"), F.max("received_at").alias("received_at"),
        *[F.min(F.when(F.col(c) != "", F.struct(place.alias("at"), F.col(c).alias("value")))).alias(f"_{c}") for c in fill],
    ).select(
        *MERGE_KEYS, "first.*", "event_count", "confidence", "received_at",
        *[F.coalesce(F.col(f"_{c}.value"), F.lit("")).alias(c) for c in fill], F.lit("open").alias("status"))


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    """Newest heartbeat per client, for an update-mode sink."""
    newest = F.max_by(F.struct(*beats.columns), "last_seen").alias("b")
    return beats.groupBy("client_id").agg(newest).select("b.*")
