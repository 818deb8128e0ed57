"""Previous row of a long sequence without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def previous_row(rows: DataFrame, keys: list[str], order: str, value: Column, out: str,
                 chunk: int = 1_000_000) -> DataFrame:
    """Add ``out``: ``value`` of the key's row before this one by the BIGINT ``order``.

    Rows are compared inside (key, order range); only the last row of a range is passed to
    the next range that has rows.
    """
    placed = rows.withColumn("_chunk", F.expr(f"`{order}` div {chunk}")).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    last = placed.groupBy(*keys, "_chunk").agg(F.max_by("_value", order).alias("_last"))
    handed = last.withColumn(
        "_handed", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))
    ).drop("_last")
    linked = placed.withColumn("_before", F.lag("_value").over(inside)).withColumn(
        "_head", F.row_number().over(inside) == 1)
    same = F.lit(True)
    renamed = handed.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, "_chunk"]})
    for k in [*keys, "_chunk"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        linked.join(renamed, same, "left")
        .withColumn(out, F.when(F.col("_head"), F.col("_handed")).otherwise(F.col("_before")))
        .select(*rows.columns, out)
    )
