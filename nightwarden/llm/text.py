"""Column helpers shared by the text operators; all are built-in SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: What separates words: the ASCII space and the five ASCII line and tab controls.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where a lambda inside body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(text: Column | str) -> Column:
    """The text, empty for NULL."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text that is not NULL."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")
