"""Search and paging on a large alert store.

The store has a folder per received day. Beside it lies an index of the values that text searches
ask for: each distinct rule, attack type and client with the days it occurs on, and a posting row
for each of its trigrams. A search for ``%x%`` finds the values that hold all trigrams of the
pattern, checks the pattern itself on those few values, and reads only the days they occur on.

Pages go by key, not by offset: the next page starts after the last row of the one before, and
days are read from the newest on until a page is full.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightwarden import fixed_values as fv
from nightwarden.session import checkpointed, if_small

GRAM = 3
TEXTS = ("rule_id", "attack_type", "client_id")
DAY = "received_day"


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text, lower case; none for a shorter text."""
    last = F.length(text) - GRAM + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def write_store(alerts: DataFrame, path: str) -> None:
    """Alerts by received day, and the index of their texts; a repeated write replaces the days it holds."""
    dated = checkpointed(alerts.withColumn(DAY, F.to_date(F.timestamp_seconds(F.floor("received_at")))))
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit("")).alias("value")) for c in TEXTS])).alias("t")
    values = checkpointed(dated.select(DAY, texts).select(DAY, "t.*").distinct())
    postings = values.select(DAY, "column", "value", F.explode(_grams(F.lower("value"))).alias("gram"))
    day_counts = dated.groupBy(DAY).agg(F.count("*").alias("n"))
    for name, table in (("alerts", dated), ("values", values), ("postings", postings.sort("gram")), ("days", day_counts)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{path}/{name}")


def matching_values(spark: SparkSession, path: str, column: str, pattern: str) -> DataFrame:
    """(value, day) of a column's values that match a pattern anywhere, ignoring case; ``%`` and ``_`` are wild."""
    literals = [part.lower() for part in re.split("[%_]", pattern)]
    grams = sorted({part[i:i + GRAM] for part in literals for i in range(len(part) - GRAM + 1)})
    if grams:
        found = spark.read.parquet(f"{path}/postings").filter((F.col("column") == column) & F.col("gram").isin(*grams)).groupBy(
            "value", DAY).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams))
    else:  # too short for a trigram: the values themselves are few
        found = spark.read.parquet(f"{path}/values").filter(F.col("column") == column)
    return checkpointed(found.filter(F.col("value").ilike(f"%{pattern}%")).select("value", DAY))


def search(spark: SparkSession, path: str, track: int | None = None, min_severity: int | None = None,
           rule_id: str | None = None, client_id: str | None = None) -> DataFrame:
    """The answer of `alert_store.search` from the index: only days and values that can match are read."""
    alerts, texts = spark.read.parquet(f"{path}/alerts"), []
    if track is not None:
        alerts = alerts.filter(F.col("track") == track)
    if min_severity is not None:
        alerts = alerts.filter(F.col("severity") >= min_severity)
    for columns, pattern in ((("rule_id", "attack_type"), rule_id), (("client_id",), client_id)):
        if pattern:
            texts.append([(c, matching_values(spark, path, c, pattern)) for c in columns])
    names = alerts.columns
    for group in texts:
        days = reduce(DataFrame.unionByName, [v.select(DAY) for _, v in group]).distinct().collect()  # as many as there are days
        alerts, hits = alerts.filter(F.col(DAY).isin(*[r[0] for r in days])), []
        for column, values in group:
            mark = f"_{column}"
            known = if_small(values.select(F.col("value").alias(mark)).distinct())
            alerts = alerts.join(known, F.coalesce(F.col(column), F.lit("")) == F.col(mark), "left")
            hits.append(F.col(mark).isNotNull())
        alerts = alerts.filter(reduce(lambda a, b: a | b, hits)).select(*names)
    return alerts.drop(DAY)


def page_after(spark: SparkSession, path: str, after: tuple[float, str] | None = None, limit: int = fv.PAGE_LIMIT,
               condition: Column | None = None) -> DataFrame:
    """The next ``limit`` alerts, newest first, after the alert with the given (received_at, alert_id).

    One day is read, then twice as many each time, until the page is full or no day is left.
    """
    alerts = spark.read.parquet(f"{path}/alerts")
    days = [r[0] for r in spark.read.parquet(f"{path}/days").select(DAY).distinct().collect()]
    wanted = [condition] if condition is not None else []
    if after is not None:
        at, alert_id = after
        wanted.append((F.col("received_at") < at) | ((F.col("received_at") == at) & (F.col("alert_id") > alert_id)))
        last = spark.range(1).select(F.to_date(F.timestamp_seconds(F.floor(F.lit(float(at)))))).first()[0]
        days = [d for d in days if d <= last]
    days.sort(reverse=True)
    found, width = None, 1
    while days:
        some, days = days[:width], days[width:]
        part = alerts.filter(F.col(DAY).isin(*some))
        part = part.filter(reduce(and_, wanted)) if wanted else part
        part = checkpointed(part.orderBy(F.desc("received_at"), "alert_id").limit(limit))
        found = part if found is None else found.unionByName(part)
        if found.count() >= limit:  # at most ``limit`` rows a turn
            break
        width *= 2
    found = alerts.limit(0) if found is None else found
    return found.orderBy(F.desc("received_at"), "alert_id").limit(limit).drop(DAY)
