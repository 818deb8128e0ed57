"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from nightwarden import fixed_values as fv


def field(name: str) -> Column:
    """Event field by its exact name; NULL when the event lacks it."""
    return F.col("data")[F.lit(name)]


def field_any_case(name: str) -> Column:
    """Event field by exact name, else by its lower-cased copy."""
    return F.coalesce(field(name), field(name.lower()))


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    """First column that is neither NULL nor empty; empty text when none is."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def pattern(regex: str) -> str:
    """Case-insensitive, Unicode aware, and ``.`` stops at newline only."""
    return f"(?idU){regex}"


def trigger(text: Column, regex: str) -> Column:
    """First match of the pattern family, empty text when there is none."""
    return F.regexp_extract(text_or_empty(text), pattern(regex), 1)


def matches(text: Column, regex: str) -> Column:
    return text_or_empty(text).rlike(pattern(regex))


def stripped(column: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.trim(column, F.lit(" \t\n\r\f\v"))


def snippet(text: Column, limit: int = fv.SNIPPET_CHARS) -> Column:
    return F.when(
        F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)


def basename(path: Column) -> Column:
    """Lower-cased last path part; both separators count."""
    return F.lower(F.regexp_extract(text_or_empty(path), r"([^\\/]*)$", 1))


def source_label(ip: Column, workstation: Column) -> Column:
    """Logon source: network address, else workstation, else a local marker."""
    address = stripped(text_or_empty(ip))
    station = stripped(text_or_empty(workstation))
    return (
        F.when(source_is_network(ip), address)
        .when((station != "") & (station != "-"), station)
        .otherwise(F.lit(fv.LOCAL_SOURCE))
    )


def source_is_network(ip: Column) -> Column:
    return ~F.lower(stripped(text_or_empty(ip))).isin(*fv.NON_ROUTABLE_SOURCES)


def in_privileged_group(name: Column) -> Column:
    lowered = F.lower(text_or_empty(name))
    return F.exists(
        F.array(*[F.lit(g) for g in fv.PRIVILEGED_GROUPS]), lambda g: F.contains(lowered, g)
    )


def fill(template: str, **columns: Column) -> Column:
    """Text with ``{name}`` places replaced by columns, NULL shown as ``?``."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("?")))
    return F.concat(*parts)
