"""Indicator lists: text lines to the four match tables.

Input is a DataFrame with ``line_no`` and ``value``. Lists live in files a site edits, in
the default lists, or in any table; reading them again per micro-batch is the hot reload.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightwarden import fixed_ioc_lists
from nightwarden.functions import network
from nightwarden.sources.text_lines import numbered_lines

LIST_FILES = {
    "domains": "ioc_domains.txt",
    "addresses": "ioc_ips.txt",
    "process_names": "ioc_process_names.txt",
    "process_chains": "ioc_process_chains.txt",
}


@dataclass(frozen=True)
class Indicators:
    domains: DataFrame
    addresses: DataFrame
    process_names: DataFrame
    process_chains: DataFrame

    def sizes(self) -> DataFrame:
        """Entries per list."""
        tagged = [
            self.domains.select(F.lit("domains").alias("list")),
            self.addresses.select(F.lit("ip_ranges").alias("list")),
            self.process_names.select(F.lit("process_names").alias("list")),
            self.process_chains.select(F.lit("process_chains").alias("list")),
        ]
        union = tagged[0]
        for other in tagged[1:]:
            union = union.unionByName(other)
        return union.groupBy("list").agg(F.count("*").alias("entries"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Cut comments, trim, drop empty lines."""
    entry = F.trim(F.element_at(F.split("value", "#"), 1), F.lit(" \t\r\n"))
    return lines.select("line_no", entry.alias("entry")).filter("entry != ''")


def domains(lines: DataFrame) -> DataFrame:
    lowered = F.lower("entry")
    wildcard = F.startswith(lowered, F.lit("*."))
    return clean_lines(lines).select(
        F.when(wildcard, F.substr(lowered, F.lit(3))).otherwise(lowered).alias("entry"),
        wildcard.alias("is_suffix"),
    ).distinct()


def addresses(lines: DataFrame) -> DataFrame:
    """Exact addresses (``prefix`` NULL) and networks with their host bits masked off.

    The mask may be a prefix length or dotted. Entries that are no address are skipped.
    """
    parts = F.split("entry", "/")
    base, mask = network.ipv4_number(parts[0]), F.get(parts, F.lit(1))
    dotted = F.lit(2**32 - 1).bitwiseXOR(network.ipv4_number(mask))  # host part of the mask
    prefix = F.coalesce(
        F.when(mask.rlike(r"^[0-9]{1,2}$") & (mask.try_cast("int") <= 32), mask.try_cast("int")),
        F.when(dotted.bitwiseAND(dotted + 1) == 0, 32 - F.bit_count(dotted)),
    )
    is_network = F.contains("entry", F.lit("/"))
    ipv6 = F.col("entry").rlike(r"(?i)^[0-9a-f:.]*:[0-9a-f:.]*$")
    parsed = clean_lines(lines).select(
        "line_no", "entry", is_network.alias("is_network"), base.alias("base"),
        F.when(is_network, prefix).cast("int").alias("prefix"), ipv6.alias("ipv6"),
    ).filter("(is_network and base is not null and prefix is not null) or "
             "(not is_network and (base is not null or ipv6))")
    span = F.expr("shiftleft(1L, 32 - coalesce(prefix, 32))")
    low = F.col("base") - F.pmod(F.col("base"), span)
    exact = (
        parsed.filter(~F.col("is_network")).groupBy(F.col("entry").alias("label"))
        .agg(F.first("base").alias("lo"), F.min("line_no").alias("line_no"))
        .select("label", "lo", F.col("lo").alias("hi"), F.lit(None).cast("int").alias("prefix"), "line_no")
    )
    networks = parsed.filter("is_network").select(
        F.concat(network.ipv4_text(low), F.lit("/"), F.col("prefix").cast("string")).alias("label"),
        low.alias("lo"), (low + span - 1).alias("hi"), "prefix", "line_no",
    )
    return networks.unionByName(exact)


def process_names(lines: DataFrame) -> DataFrame:
    return clean_lines(lines).select(F.lower("entry").alias("name")).distinct()


def process_chains(lines: DataFrame) -> DataFrame:
    """``parent -> child [reason]``; the last line of a pair wins."""
    arrow = r"^(\S+)\s*->\s*(\S+)(.*)$"
    parsed = clean_lines(lines).filter(F.col("entry").rlike(arrow)).select(
        "line_no",
        F.lower(F.regexp_extract("entry", arrow, 1)).alias("parent"),
        F.lower(F.regexp_extract("entry", arrow, 2)).alias("child"),
        F.trim(F.regexp_extract("entry", arrow, 3)).alias("text"),
    )
    default = F.concat(F.col("parent"), F.lit(" spawning "), F.col("child"))
    return parsed.groupBy("parent", "child").agg(F.max_by("text", "line_no").alias("text")).select(
        "parent", "child", F.when(F.col("text") != "", F.col("text")).otherwise(default).alias("reason"),
    )


def from_lines(domain_lines: DataFrame, address_lines: DataFrame, name_lines: DataFrame,
               chain_lines: DataFrame) -> Indicators:
    return Indicators(domains(domain_lines), addresses(address_lines),
                      process_names(name_lines), process_chains(chain_lines))


def read_text(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a text with their number."""
    entries = F.posexplode(F.split(F.lit(text.strip()), "\n")).alias("line_no", "value")
    return spark.range(1).select(entries).withColumn("line_no", F.col("line_no").cast("bigint"))


def default_indicators(spark: SparkSession) -> Indicators:
    return from_lines(*(read_text(spark, text) for text in (
        fixed_ioc_lists.DOMAINS, fixed_ioc_lists.ADDRESSES, fixed_ioc_lists.PROCESS_NAMES, fixed_ioc_lists.PROCESS_CHAINS)))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one list file with their position; a missing file is an empty list."""
    return numbered_lines(spark, path).select("line_no", "value")


def read_indicators(spark: SparkSession, directory: str) -> Indicators:
    """Read the four lists of a folder; call again to pick up changed files."""
    lines = {name: read_list(spark, f"{directory}/{file}") for name, file in LIST_FILES.items()}
    return from_lines(lines["domains"], lines["addresses"], lines["process_names"],
                      lines["process_chains"])


ENTRY = ("list STRING, entry STRING, is_suffix BOOLEAN, lo BIGINT, hi BIGINT, prefix INT, line_no BIGINT, "
         "parent STRING, child STRING, reason STRING")


def publish(lists: Indicators, path: str, version: int) -> None:
    """Write the four lists as one version of an indicator table, then the row that points to it.

    Readers follow the pointer, so they see a version with all its lists or not at all. Writing a
    version again replaces it.
    """
    names = [c.split()[0] for c in ENTRY.split(", ")]
    parts = [
        lists.domains.select(F.lit("domains").alias("list"), "entry", "is_suffix"),
        lists.addresses.select(F.lit("addresses").alias("list"), F.col("label").alias("entry"), "lo", "hi", "prefix", "line_no"),
        lists.process_names.select(F.lit("process_names").alias("list"), F.col("name").alias("entry")),
        lists.process_chains.select(F.lit("process_chains").alias("list"), "parent", "child", "reason"),
    ]
    empty = lists.domains.sparkSession.createDataFrame([], ENTRY)
    for part in parts:
        empty = empty.unionByName(part, allowMissingColumns=True)
    empty.select(*names).write.mode("overwrite").parquet(f"{path}/entries/version={version}")
    pointer = lists.domains.sparkSession.range(1).select(F.lit(version).cast("bigint").alias("version"))
    pointer.write.mode("append").parquet(f"{path}/pointer")


def current(spark: SparkSession, path: str) -> tuple[int, Indicators]:
    """The version that is pointed to now, and its lists; all four are of that version."""
    version = spark.read.schema("version BIGINT").parquet(f"{path}/pointer").agg(F.max("version")).first()[0]
    entries = spark.read.schema(ENTRY).parquet(f"{path}/entries/version={version}")
    part = lambda name: entries.filter(F.col("list") == name)
    return version, Indicators(
        part("domains").select("entry", "is_suffix"),
        part("addresses").select(F.col("entry").alias("label"), "lo", "hi", "prefix", "line_no"),
        part("process_names").select(F.col("entry").alias("name")),
        part("process_chains").select("parent", "child", "reason"))
