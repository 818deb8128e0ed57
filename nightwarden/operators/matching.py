"""Indicator matches as equi-joins.

Distinct lookups are matched first (duplicates of a hot value collapse map-side), then
the hits go back to the events with one equi-join. Join strategies are left to Spark,
which broadcasts a side only when its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nightwarden.functions import network, text


def match_domains(events: DataFrame, query: str, domains: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the exact entry if listed, else ``*.suffix`` of the longest suffix."""
    normal = F.rtrim(F.lower(text.text_or_empty(F.col(query))), F.lit("."))
    looked_up = events.withColumn("_query", normal)
    labels = F.split("_query", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    exact = F.col("entry") == F.col("_query")
    hits = (
        looked_up.select("_query").distinct()
        .select("_query", F.explode(suffixes).alias("entry"))
        .join(domains.select("entry", "is_suffix").distinct(), "entry")
        .filter(F.col("is_suffix") | exact)
        .groupBy("_query")
        .agg(F.max_by(
            F.when(F.col("is_suffix"), F.concat(F.lit("*."), F.col("entry")))
            .otherwise(F.col("entry")),
            F.struct(~F.col("is_suffix"), F.length("entry")),
        ).alias(out))
    )
    return looked_up.join(hits, "_query", "left").drop("_query")


def match_addresses(events: DataFrame, address: str, addresses: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the exact entry if listed, else the first network (file order) around it.

    A network of prefix length n is an equality on (n, address >> (32 - n)), so one equi-join
    finds exact entries and networks alike.
    """
    looked_up = events.withColumn("_address", text.stripped(text.text_or_empty(F.col(address))))
    is_network = F.col("prefix").isNotNull()
    entries = addresses.select(
        "label", F.struct(is_network.alias("network"), "line_no").alias("rank"),
        F.when(is_network, _network_key(F.col("lo"), F.col("prefix"))).otherwise(F.col("label")).alias("key"),
    )
    prefixes = addresses.agg(F.collect_set("prefix")).scalar()  # at most 33 values
    number = network.ipv4_number(F.col("_address"))
    candidates = F.when(
        number.isNull(), F.array("_address")
    ).otherwise(F.concat(F.array("_address"), F.transform("_prefixes", lambda n: _network_key(number, n))))
    hits = (
        looked_up.select("_address").distinct()
        .withColumn("_prefixes", prefixes)
        .select("_address", F.explode(candidates).alias("key"))
        .join(entries, "key")
        .groupBy("_address")
        .agg(F.min_by("label", "rank").alias(out))
    )
    return looked_up.join(hits, "_address", "left").drop("_address")


def _network_key(number, prefix):
    bits = F.call_function("shiftright", number, F.lit(32) - prefix)
    return F.concat_ws("/", bits.cast("string"), prefix.cast("string"))


def match_process_names(events: DataFrame, path: str, names: DataFrame, out: str) -> DataFrame:
    return (
        events.withColumn("_name", text.basename(F.col(path)))
        .join(names.select(F.col("name").alias("_name"), F.col("name").alias(out)), "_name", "left")
        .drop("_name")
    )


def match_process_chains(
    events: DataFrame, parent: str, child: str, chains: DataFrame, out: str
) -> DataFrame:
    listed = chains.select(
        F.col("parent").alias("_parent"), F.col("child").alias("_child"), F.col("reason").alias(out)
    )
    return (
        events.withColumn("_parent", text.basename(F.col(parent)))
        .withColumn("_child", text.basename(F.col(child)))
        .join(listed, ["_parent", "_child"], "left")
        .drop("_parent", "_child")
    )
