"""Event XML to host events, and the subscription filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from nightwarden import fixed_values as fv

XML_SCHEMA = (
    "System STRUCT<Provider: STRUCT<_Name: STRING>, EventID: STRING, Level: STRING, Channel: STRING, "
    "Computer: STRING, TimeCreated: STRUCT<_SystemTime: STRING>>, "
    "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
)
LEAF = r"<([\w.-]+)(?:\s[^<>]*)?>([^<]*)</\1\s*>"


def _entries(data: Column) -> Column:
    """Name and value as written; a value without a name is ``data_<position>``."""
    return F.transform(
        F.coalesce(data, F.array()),
        lambda d, i: F.struct(
            F.coalesce(F.nullif(d["_Name"], F.lit("")), F.concat(F.lit("data_"), i.cast("string"))).alias("key"),
            F.trim(F.coalesce(d["_VALUE"], F.lit(""))).alias("value"),
        ),
    )


def _both_spellings(entries: Column) -> Column:
    """Every entry under its name and its lower case; a later repetition overwrites both."""
    return F.map_from_entries(F.flatten(F.transform(
        entries, lambda e: F.array(e, F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))


def _decoded(value: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return F.trim(value)


def _user_data(xml: Column) -> Column:
    """All leaves of free-form user data that hold a value; the first value of a name wins."""
    plain = F.regexp_replace(xml, r"(</?)[\w.-]+:", "$1")  # no prefixes
    leaves = F.arrays_zip(F.regexp_extract_all(plain, F.lit(LEAF), F.lit(1)).alias("key"),
                          F.regexp_extract_all(plain, F.lit(LEAF), F.lit(2)).alias("value"))
    entries = F.transform(leaves, lambda e: F.struct(e["key"].alias("key"), _decoded(e["value"]).alias("value")))
    found = F.reverse(F.filter(entries, lambda e: e["value"] != ""))  # the last entry of a name is kept
    return F.when(xml.isNotNull() & F.contains(xml, F.lit("<")), _both_spellings(found)).otherwise(
        F.create_map().cast("map<string,string>"))


def _parsed(raw: DataFrame, xml: str, log_id: str) -> DataFrame:
    """System fields and the parsed record ``x``; text that is no event XML is dropped."""
    parse = F.from_xml(F.col("raw_xml"), XML_SCHEMA, {"mode": "PERMISSIVE"})
    # Exploding the kept record parses once; a plain filter on it would parse twice.
    kept = F.filter(F.array(parse), lambda x: x["System"].isNotNull())
    parsed = raw.select(F.col(log_id).alias("log_id"), F.col(xml).alias("raw_xml")).select(
        "log_id", "raw_xml", F.explode(kept).alias("x"))
    system = lambda path: F.trim(F.coalesce(F.col(f"x.System.{path}"), F.lit("")))
    return parsed.select(
        "log_id",
        F.coalesce(F.col("x.System.Provider._Name"), F.lit("")).alias("provider"),
        system("EventID").try_cast("int").alias("event_id"),
        system("EventID").alias("event_code"),
        system("Level").alias("level"),
        system("Channel").alias("channel"),
        system("Computer").alias("computer"),
        F.try_to_timestamp(F.col("x.System.TimeCreated._SystemTime")).alias("event_time"),
        "x", "raw_xml",
    )


def parse_events(raw: DataFrame, xml: str = "raw_xml", log_id: str = "log_id") -> DataFrame:
    """Host events from raw XML; event data wins over user data of the same name."""
    # Taken from the text itself: the parsed record would mix markup with decoded signs.
    user = F.regexp_extract("raw_xml", r"(?s)<UserData[^<>]*>(.*)</UserData>", 1)
    data = F.map_concat(_user_data(user), _both_spellings(_entries(F.col("x.EventData.Data"))))
    return _parsed(raw, xml, log_id).select(
        "log_id", "provider", "event_id", "event_code", "level", "channel", "computer", "event_time", data.alias("data"), "raw_xml")


def nested_view(raw: DataFrame, xml: str = "raw_xml", log_id: str = "log_id") -> DataFrame:
    """Display form: system fields plus the event data as written, one nested map."""
    return _parsed(raw, xml, log_id).select(
        "log_id", "event_code", "channel", "computer", "provider", "level", "event_time",
        F.to_json(F.map_from_entries(_entries(F.col("x.EventData.Data")))).alias("data_json"),
    )


def subscribed(events: DataFrame) -> DataFrame:
    """Events of the subscribed channels; an empty id set accepts the whole channel."""
    wanted = F.lit(False)
    for channel, ids in fv.SUBSCRIPTIONS.items():
        accepted = F.col("channel") == channel
        if ids:
            accepted = accepted & F.col("event_id").isin(*ids)
        wanted = wanted | accepted
    return events.filter(wanted)
