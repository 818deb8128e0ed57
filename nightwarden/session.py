"""Session settings the plans rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    # Event clocks are compared with epoch values, so the zone is pinned.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A repeated field name in one event overwrites the earlier value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes; wide rows then run far faster as
    # separate projections than as one generated method that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # State on disk, changed entry by entry; arbitrary state needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder the cluster names for checkpoints; local sessions get their own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    return tempfile.mkdtemp(prefix="nightwarden-checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by way of a table in the checkpoint folder.

    Unlike a checkpointed plan, the table carries no notion of its former partitioning.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 200_000


def if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, broadcast in a join if it has at most ``rows``; else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def local_session(cpus: int | str = "*", **extra: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster supplies its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("nightwarden")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
