"""Gap sessions in two steps, so that a hot key never meets in one task as raw rows.

Rows are grouped into sessions inside (key, time chunk) first and aggregated there; only
the few partial sessions of a chunk travel on, and neighbours across chunk borders are
joined when their gap allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def session_partials(
    rows: DataFrame, keys: list[str], seconds: str, order: str, gap: float,
    aggregates: list[Column], chunk_seconds: float = 300.0,
) -> DataFrame:
    """One row per (key, chunk, session inside the chunk) with ``_start`` and ``_end``."""
    chunk = F.floor(F.col(seconds) / F.lit(chunk_seconds)).cast("bigint")
    by_time = Window.partitionBy(*keys, "_chunk").orderBy(seconds, order)
    previous = F.lag(seconds).over(by_time)
    opened = F.when(previous.isNull() | (F.col(seconds) - previous > gap), 1).otherwise(0)
    return (
        rows.withColumn("_chunk", chunk)
        .withColumn("_opened", opened)
        .withColumn("_session", F.sum("_opened").over(
            by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "_chunk", "_session")
        .agg(F.min(seconds).alias("_start"), F.max(seconds).alias("_end"), *aggregates)
    )


def join_partials(
    partials: DataFrame, keys: list[str], gap: float, aggregates: list[Column],
) -> DataFrame:
    """Merge partial sessions whose distance is at most the gap."""
    by_start = Window.partitionBy(*keys).orderBy("_start")
    previous = F.lag("_end").over(by_start)
    opened = F.when(previous.isNull() | (F.col("_start") - previous > gap), 1).otherwise(0)
    return (
        partials.withColumn("_opened", opened)
        .withColumn("_session", F.sum("_opened").over(
            by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*keys, "_session")
        .agg(*aggregates)
        .drop("_session")
    )
