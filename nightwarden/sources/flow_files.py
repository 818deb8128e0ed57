"""Flow files: the 84-column form and the model rows, batch and stream."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightwarden import fixed_values as fv
from nightwarden.schemas import MODEL_FLOWS
from nightwarden.session import checkpointed, if_small
from nightwarden.sources.text_lines import first_lines, numbered_lines, text_lines

OPEN_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

def write_flows84(flows84: DataFrame, path: str) -> None:
    """The 84 columns with a header line; writers append files, never rewrite them."""
    flows84.select(*[F.col(f"`{c}`") for c in fv.FLOW_COLUMNS]).write.mode("append").option("header", True).csv(path)


def with_flow_date(rows: DataFrame) -> DataFrame:
    return rows.withColumn("flow_date", F.to_date(F.timestamp_seconds(F.floor("FlowStartTime"))))


def read_flows84(spark: SparkSession, path: str) -> DataFrame:
    """Flow files of the 84 columns, each by its own header; figures as DOUBLE, the rest as text."""
    texts = ("Flow ID", "Src IP", "Dst IP", "Timestamp", "Label")
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(f"`{c}`") if c in texts else F.col(f"`{c}`").try_cast("double").alias(c) for c in fv.FLOW_COLUMNS])


#: Day folders a task writes at once, and the bytes it gathers for each.
OPEN_DAYS, DAY_BYTES = 32, 8 << 20


def write_days(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Rows with ``flow_date`` in one folder per day.

    A task keeps the files of `OPEN_DAYS` days open, so rows are written as they come; only those
    of further days are sorted by day first.
    """
    conf = rows.sparkSession.conf
    before = conf.get(OPEN_WRITERS, "0")
    conf.set(OPEN_WRITERS, str(OPEN_DAYS))
    try:
        writer = rows.write.mode(mode).partitionBy("flow_date").option("parquet.block.size", DAY_BYTES)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
    finally:
        conf.set(OPEN_WRITERS, before)


def write_model_rows(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Model rows in one folder per day."""
    columns = [*[c for c in ("client_id", "flow_no") if c in rows.columns], *fv.MODEL_FEATURES, "FlowStartTime"]
    write_days(with_flow_date(rows.select(*columns)), path, fmt)


COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # not inside quotes


def _named(lines: DataFrame) -> DataFrame:
    """Cells of CSV lines (header, value) by the trimmed names of their file's header, as one map."""
    # Looking for quotes ahead of every comma takes the square of a line's length; most lines have none.
    quoted = lambda line: F.transform(F.split(line, COMMA), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    cells = lambda line: F.when(F.contains(line, F.lit('"')), quoted(line)).otherwise(F.transform(F.split(line, ","), lambda c: F.trim(c)))
    pairs = F.arrays_zip(cells(F.col("header")).alias("key"), cells(F.col("value")).alias("value"))
    named = F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull() & (p["key"] != "")))
    # Exploded, so that the columns taken from it do not each parse the line again.
    return lines.select(F.explode(F.array(named)).alias("cells"))


def typed_cells(lines: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema from CSV lines (header, value); what is no such value is NULL."""
    kinds = [c.split() for c in schema.split(", ")]
    return _named(lines).select(*[F.col("cells")[name].try_cast(kind).alias(name) for name, kind in kinds])


def _model_rows(cells: DataFrame, names: list[str], rest: list[str]) -> DataFrame:
    number = lambda c: F.col("cells")[c].try_cast("double").alias(c)
    return cells.select(*[F.col("cells")[c].alias(c) for c in rest], *[number(c) for c in names])


def read_model_csv(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Model rows from CSV files; each file's columns are matched by its own header.

    Files may have their columns in any order, or lack some. Values that are no number are
    NULL; columns no model knows come along as text. Lines equal to the header are headers.
    Lines stay where they are read: a file's kind of header and the kinds are sent to them.
    """
    names = [c.split()[0] for c in f"{MODEL_FLOWS}{extra}".split(", ")]
    lines = text_lines(spark, path)
    firsts = lines.filter("_split = 0").groupBy("file").agg(F.min_by("value", "_read").alias("header"))
    headers = checkpointed(firsts.withColumn("kind", F.sha2("header", 256)))
    columns = headers.select(F.explode(F.split("header", ",")).alias("c")).select(F.trim("c").alias("c")).distinct()
    rest = sorted({r.c for r in columns.collect()} - set(names) - {""})  # as many as there are column names
    kinds = if_small(headers.select("kind", "header").distinct())
    titled = lines.join(if_small(headers.select("file", "kind")), "file").join(kinds, "kind")
    body = titled.filter((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    return _model_rows(_named(body), names, rest)


def stream_model_csv(spark: SparkSession, path: str, schema: str = MODEL_FLOWS, files_per_trigger: int = 1000) -> DataFrame:
    """New files since the last trigger, each by its own header.

    The checkpoint remembers what was read, so a restart goes on where it stopped; producers
    add files instead of appending lines (`flow_tail` follows files that grow). Files are read in
    splits, line by line; the task that reads a split takes the header from the file's start, so
    the path must be one that pyarrow can open too.
    """
    found = spark.readStream.schema("value STRING").format("text").option("lineSep", "\n").option(
        "maxFilesPerTrigger", files_per_trigger).load(path)
    line = F.regexp_replace("value", "\r$", "")
    lines = found.select(line.alias("value"), first_lines(F.col("_metadata.file_path")).alias("first"))
    body = lines.select("value", "first", F.regexp_replace("first", "^\ufeff", "").alias("header"))
    return typed_cells(body.filter((F.col("value") != F.col("first")) & (F.col("value") != F.col("header")) & (F.trim("value") != "")), schema)


def read_days(spark: SparkSession, path: str, first: dt.date, last: dt.date | None = None) -> DataFrame:
    """Model rows of a span of days; only their folders are listed and read."""
    rows = spark.read.parquet(path).filter(F.col("flow_date") >= F.lit(first))
    return rows if last is None else rows.filter(F.col("flow_date") <= F.lit(last))


def retained(rows: DataFrame, today: dt.date, days: int = fv.RETAIN_DAYS) -> DataFrame:
    return rows.filter(F.col("flow_date") >= F.lit(today - dt.timedelta(days=days)))


def archive_old(spark: SparkSession, path: str, archive: str, today: dt.date, days: int = fv.RETAIN_DAYS) -> DataFrame:
    """Copy day folders past the retention to the archive and return what is still current.

    Day folders replace their archived copy, so a repeated run changes nothing. Removing the
    originals is left to the storage's own life-cycle rules.
    """
    rows = spark.read.parquet(path)
    old = rows.filter(F.col("flow_date") < F.lit(today - dt.timedelta(days=days)))
    write_days(old, archive, mode="overwrite")
    return retained(rows, today, days)


def export_alerts(alerts: DataFrame, path: str) -> None:
    """Filtered alerts as CSV with a header; nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in alerts.dtypes]
    alerts.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


TRUTH_COLUMNS = "unix_us STRING, event STRING, attack_type STRING, detail STRING"


def read_truth_logs(spark: SparkSession, path: str, client_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Ground-truth logs of many clients, each file in its own order; a missing path is an empty log.

    ``client_pattern`` finds the client in a file's path; by default it is the file's folder.
    """
    client = F.regexp_extract("file", client_pattern, 1)
    return numbered_lines(spark, path).filter("line_no > 1 and value != ''").select(
        "file", "line_no", F.from_csv("value", TRUTH_COLUMNS).alias("r"), client.alias("client_id")
    ).select("file", "line_no", "r.*", "client_id")


def read_truth_log(spark: SparkSession, path: str, client_id: str) -> DataFrame:
    """Ground-truth log of one client."""
    return read_truth_logs(spark, path).withColumn("client_id", F.lit(client_id))
