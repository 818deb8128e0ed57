"""Sliding total and distinct counts over an event-time window.

One key may hold a third of all events, so the timeline of a key is cut into chunks and
each chunk also receives the events of one window length before it. The counts of a chunk
are then exact on their own and a key spreads over as many tasks as it has chunks.

The distinct count needs no set per row: a value is "present" from an occurrence that had
none within the window before it until one window after the last occurrence of that
stretch, so presence is a running sum of +1/-1 marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from nightwarden import fixed_values as fv

CHUNK_WINDOWS = 10


def sliding_counts(
    events: DataFrame,
    keys: list[str],
    micros: str,
    order: str,
    value: Column,
    *,
    window_us: int = fv.WINDOW_SECONDS * 1_000_000,
    chunk_us: int | None = None,
) -> DataFrame:
    """Append ``window_total`` and ``window_distinct`` to every event.

    An event counts itself and the events before it (by time, then ``order``) that are no
    older than the window, bound included. NULL and empty values add to the total only.
    """
    chunk_us = chunk_us or CHUNK_WINDOWS * window_us
    if chunk_us < window_us:
        raise ValueError("a chunk must cover at least one window")

    columns = events.columns
    own = F.floor(F.col(micros) / F.lit(chunk_us)).cast("bigint")
    spills_over = F.pmod(F.col(micros), F.lit(chunk_us)) >= chunk_us - window_us
    placements = F.when(spills_over, F.array(own, own + 1)).otherwise(F.array(own))
    placed = (
        events.withColumn("_value", F.nullif(value.cast("string"), F.lit("")))
        .withColumn("_chunk", F.explode(placements))
        .repartition(*keys, "_chunk")
    )

    same_value = Window.partitionBy(*keys, "_chunk", "_value").orderBy(micros, order)
    before = F.lag(micros).over(same_value)
    after = F.lead(micros).over(same_value)
    has_value = F.col("_value").isNotNull()
    marked = placed.withColumn(
        "_appears",
        (has_value & (before.isNull() | (F.col(micros) - before > window_us))).cast("int"),
    ).withColumn(
        "_vanishes",
        (has_value & (after.isNull() | (after - F.col(micros) > window_us))).cast("int"),
    )

    row = F.struct(*[F.col(c) for c in columns])
    arrival = F.struct(
        F.col(micros).alias("at"), F.lit(1).alias("total"), F.col("_appears").alias("distinct"),
        row.alias("row"),
    )
    expiry = F.struct(
        (F.col(micros) + window_us + 1).alias("at"), F.lit(-1).alias("total"),
        (-F.col("_vanishes")).alias("distinct"),
        F.when(F.lit(False), row).alias("row"),
    )
    steps = (
        marked.select(
            *keys, "_chunk", F.col(order).alias("_order"),
            F.explode(F.array(arrival, expiry)).alias("step"),
        )
        # A step past the chunk end cannot be seen from inside the chunk.
        .filter(F.col("step.at") < (F.col("_chunk") + 1) * chunk_us)
    )
    running = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy("step.at", "step.total", "_order")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = steps.select(
        "_chunk",
        F.col("step.row").alias("row"),
        F.sum("step.total").over(running).alias("window_total"),
        F.sum("step.distinct").over(running).alias("window_distinct"),
    )
    return counted.filter(
        F.col("row").isNotNull()
        & (F.floor(F.col(f"row.{micros}") / F.lit(chunk_us)) == F.col("_chunk"))
    ).select("row.*", "window_total", "window_distinct")
