"""The newest row per key, kept by a stream.

A micro-batch writes the newest row of each key it brought under its own number, so its cost does
not depend on how many keys there are, and a replayed batch replaces itself. Readers take the
newest over all batches. `compact` folds batches into a base; it is written under the number of
the last batch it holds, so a reader uses one base and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightwarden.session import checkpointed


class LatestTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str]):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order
        for name, number in (("changes", "batch_id"), ("base", "upto")):
            spark.createDataFrame([], f"{schema}, {number} BIGINT").write.mode("append").partitionBy(number).parquet(f"{path}/{name}")

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [c.split()[0] for c in self.schema.split(", ")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(*self.order)).alias("r")).select("r.*")

    def _table(self, name: str, number: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {number} BIGINT").parquet(f"{self.path}/{name}")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """The function for foreachBatch."""
        self._newest(batch).write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")

    def read(self) -> DataFrame:
        bases = self._table("base", "upto")
        upto = bases.agg(F.max("upto")).first()[0]
        held = bases.filter(F.col("upto") == F.lit(upto)).drop("upto")
        later = self._table("changes", "batch_id").filter(F.col("batch_id") > F.lit(-1 if upto is None else upto)).drop("batch_id")
        return self._newest(held.unionByName(later))

    def compact(self, upto: int) -> None:
        """Fold all batches up to a number that no running batch has into a new base."""
        bases = self._table("base", "upto")
        last = bases.filter(F.col("upto") <= upto).agg(F.max("upto")).first()[0]
        low = -1 if last is None else last
        changes = self._table("changes", "batch_id").filter((F.col("batch_id") > low) & (F.col("batch_id") <= upto)).drop("batch_id")
        if low < upto:
            rows = checkpointed(self._newest(bases.filter(F.col("upto") == low).drop("upto").unionByName(changes)))
            rows.write.mode("overwrite").parquet(f"{self.path}/base/upto={upto}")
