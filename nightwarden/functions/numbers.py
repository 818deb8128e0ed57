"""Numeric helpers with the NULL/NaN/infinity rules the flow features need."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nightwarden import fixed_values as fv

NAN = float("nan")
INF = float("inf")


def severity(confidence: Column) -> Column:
    """Severity bucket; the comparison happens in DOUBLE."""
    value = confidence.cast("double")
    chain = None
    for cut, level in fv.SEVERITY_CUTS:
        chain = F.when(value >= cut, level) if chain is None else chain.when(value >= cut, level)
    return chain.otherwise(fv.SEVERITY_LOW)


def finite_or_zero(column: Column) -> Column:
    """Number, or 0 for NULL, NaN, infinities and text that is no number."""
    value = column.try_cast("double")
    # One comparison does: it fails for NULL, for the infinities, and for NaN, which Spark
    # orders above everything.
    return F.when(F.abs(value) < INF, value).otherwise(0.0)


def number_or_zero(column: Column) -> Column:
    """NULL and text that is no number count as 0; NaN stays NaN."""
    return F.coalesce(column.try_cast("double"), F.lit(0.0))


def no_number(column: Column) -> Column:
    """True for text that is no number; an empty cell is none at all."""
    return (column.cast("string") != "") & column.try_cast("double").isNull()


def ordered(column: Column, compare) -> Column:
    """Comparison that is false for NaN (Spark orders NaN above everything)."""
    return ~F.isnan(column) & compare(column)


def or_nan(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(NAN))


def summary(column: Column, prefix: str) -> list[Column]:
    """n, sum, min, max, mean, sample variance and deviation.

    Empty input: sum 0, min +inf, max -inf, mean NaN. Fewer than two values: NaN spread.
    """
    return [
        F.count(column).alias(f"{prefix}_n"),
        F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias(f"{prefix}_sum"),
        F.coalesce(F.min(column).cast("double"), F.lit(INF)).alias(f"{prefix}_min"),
        F.coalesce(F.max(column).cast("double"), F.lit(-INF)).alias(f"{prefix}_max"),
        or_nan(F.avg(column)).alias(f"{prefix}_mean"),
        or_nan(F.var_samp(column)).alias(f"{prefix}_variance"),
        or_nan(F.stddev_samp(column)).alias(f"{prefix}_std"),
    ]


def protocol_number(column: Column) -> Column:
    text = F.lower(column.cast("string"))
    chain = None
    for name, number in fv.PROTOCOL_NUMBERS.items():
        chain = F.when(text == name, number) if chain is None else chain.when(text == name, number)
    return chain.otherwise(0)
