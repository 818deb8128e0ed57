"""Alert-id uniqueness of a stream against the whole store.

The store keeps the ids of all arrivals by received day, and for every day a blocked Bloom filter:
rows (block, four words of 64 bits), so that filters of batches and days merge by bitwise or. The
filter of a batch's day has as many blocks as its ids need, a power of two times the least number,
so that a crowded day does not send every id to the store. A batch asks the filters by an equality
join on size and block; only ids that some day may hold are looked up, and only in the files of those days. Batches are written under their number, so a
replayed batch replaces itself and does not take its own ids for old ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightwarden.plans.alert_store import identified, unique_alerts
from nightwarden.session import checkpointed

#: Least number of blocks of 256 bits a day; at 16 ids a block about one id in 200 is looked up in vain.
BLOCKS, BLOCK_IDS = 1 << 20, 16
WORDS = [f"w{i}" for i in range(4)]
IDS = "alert_id STRING, received_day DATE, batch_id BIGINT"
FILTERS = f"blocks BIGINT, block BIGINT, {', '.join(f'{w} BIGINT' for w in WORDS)}, received_day DATE, batch_id BIGINT"
MERGED = -1  # the batch number of a day's merged filter


def _marked(ids: DataFrame) -> DataFrame:
    """Ids with their block, of ``blocks``, and the bits they set there: two in each word."""
    second = F.xxhash64(F.lit(1), "alert_id")
    bit = lambda k: F.expr(f"shiftleft(1L, CAST((_h >> {6 * k}) & 63 AS INT))")
    hashed = ids.withColumn("_h", second).withColumn("block", F.pmod(F.xxhash64("alert_id"), F.col("blocks")))
    return hashed.withColumns({w: bit(2 * i).bitwiseOR(bit(2 * i + 1)) for i, w in enumerate(WORDS)}).drop("_h")


def _merged(filters: DataFrame, *keys: str) -> DataFrame:
    return filters.groupBy(*keys).agg(*(F.bit_or(w).alias(w) for w in WORDS))


class AlertIds:
    """Ids of all arrivals below a path."""

    def __init__(self, spark: SparkSession, path: str, blocks: int = BLOCKS):
        self.spark, self.path, self.blocks = spark, path, blocks
        for name, schema in (("ids", IDS), ("filters", FILTERS)):
            spark.createDataFrame([], schema).write.mode("append").partitionBy("received_day", "batch_id").parquet(f"{path}/{name}")

    def _before(self, name: str, schema: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("batch_id") < batch_id)

    def known(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """Those of the ids that an earlier batch brought."""
        filters = self._before("filters", FILTERS, batch_id)
        sizes = [r[0] for r in filters.select("blocks").distinct().collect()]  # powers of two, a few
        asked = _marked(ids.select("alert_id").distinct().withColumn("blocks", F.explode(F.lit(sizes).cast("array<bigint>"))))
        days = _merged(filters, "received_day", "blocks", "block").select("received_day", "blocks", "block", *(F.col(w).alias(f"f{w}") for w in WORDS))
        holds: Column = F.lit(True)
        for w in WORDS:
            holds = holds & (F.col(w).bitwiseAND(F.col(f"f{w}")) == F.col(w))
        maybe = checkpointed(asked.join(days, ["blocks", "block"]).filter(holds).select("alert_id", "received_day"))
        days_hit = [r[0] for r in maybe.select("received_day").distinct().collect()]  # as many as there are days
        stored = self._before("ids", IDS, batch_id).filter(F.col("received_day").isin(*days_hit))
        return maybe.join(stored, ["alert_id", "received_day"], "left_semi").select("alert_id").distinct()

    def record(self, arrivals: DataFrame, batch_id: int) -> None:
        """Keep the ids of a batch and their filter."""
        day = F.to_date(F.timestamp_seconds(F.floor("received_at")))
        rows = arrivals.select("alert_id", day.alias("received_day"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        rows = checkpointed(rows)
        full = F.ceil(F.col("_n") / float(BLOCK_IDS * self.blocks))
        doubled = F.greatest(F.ceil(F.log2(full.cast("double"))), F.lit(0)).cast("int")
        sizes = rows.groupBy("received_day").agg(F.count("*").alias("_n")).select(
            F.col("received_day").alias("_day"), F.call_function("shiftleft", F.lit(self.blocks).cast("bigint"), doubled).alias("blocks"))
        sized = rows.join(F.broadcast(sizes), F.col("received_day").eqNullSafe(F.col("_day"))).drop("_day")
        filters = _merged(_marked(sized), "received_day", "batch_id", "blocks", "block")
        for name, table in (("ids", rows), ("filters", filters)):
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "received_day", "batch_id").parquet(f"{self.path}/{name}")

    def merge_day(self, day) -> None:
        """One filter for a day that is over, beside those of its batches."""
        filters = self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters").filter(F.col("received_day") == F.lit(day))
        whole = checkpointed(_merged(filters, "received_day", "blocks", "block")).withColumn("batch_id", F.lit(MERGED).cast("bigint"))
        whole.sort("blocks", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "received_day", "batch_id").parquet(f"{self.path}/filters")


def first_arrivals(ids: AlertIds, order: str = "arrival") -> Callable[[DataFrame, int], DataFrame]:
    """Per micro-batch: alerts whose id nobody sent before, each once; all ids of the batch are kept."""
    def run(batch: DataFrame, batch_id: int) -> DataFrame:
        # The ids alone are asked for, before whole alerts are compared.
        known = ids.known(identified(batch, order), batch_id)
        new = checkpointed(unique_alerts(batch, order).join(known, "alert_id", "left_anti"))
        ids.record(new, batch_id)
        return new
    return run
