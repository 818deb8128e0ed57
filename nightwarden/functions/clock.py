"""Clock helpers. Microseconds since the epoch (BIGINT) is the working unit."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def to_micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column: Column) -> Column:
    return F.timestamp_micros(column)


def parse_time(text: Column) -> Column:
    """Epoch seconds from ISO text, else from numeric text, else NULL."""
    trimmed = F.trim(text.cast("string"))
    iso = F.try_to_timestamp(trimmed)
    return F.coalesce(F.unix_micros(iso) / float(MICROS), trimmed.try_cast("double"))


def twelve_hour(micros: Column) -> Column:
    """``dd/MM/yyyy hh:mm:ss AM`` in the session zone."""
    return F.date_format(from_micros(micros), "dd/MM/yyyy hh:mm:ss a")


def iso_seconds(seconds: Column) -> Column:
    """ISO-8601 UTC text with whole seconds."""
    whole = F.floor(seconds).cast("bigint")
    return F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
