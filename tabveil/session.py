"""Session settings, the shared scratch folder and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when it is known to stay under both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(app: str = "tabveil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; partition counts are left to AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Recording the Python line of every expression costs more than planning.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    A temporary folder of the machine stands in only on a local master, where
    every task sees it. On a cluster the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tabveil-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"tabveil-{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The lineage ends at files that outlive executors, the columnar copy can
    still be pruned, and its size is known to the planner afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out over the cores when it has fewer splits than cores.

    A few small files would leave everything up to the first shuffle to as many
    tasks. Larger inputs come in enough splits by themselves and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_or_same(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Fetch a table that is expected to be small, if it really is.

    Returns a local relation and True when it has at most ``max_rows`` rows and
    ``BROADCAST_BYTES`` bytes, otherwise the unchanged table and False. At most
    ``max_rows + 1`` rows ever reach the driver.
    """
    rows = table.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > BROADCAST_BYTES:
        return table, False
    return table.sparkSession.createDataFrame(rows, schema=table.schema), True


def settle(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Compute a table that will be used several times: fetched if it is small,
    otherwise written to the shared folder."""
    table, small = small_or_same(table, max_rows)
    return (table, True) if small else (materialize(table, "settled"), False)


def lookup(
    df: DataFrame, table: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join ``df`` to a table with one row per key.

    The table is broadcast when its fetched size allows. Beyond that the plain
    shuffle join stays, whose hot partitions adaptive execution splits on the
    ``df`` side (each key has one partner, so a split never multiplies work).
    """
    table, small = small_or_same(table, max_rows)
    return df.join(F.broadcast(table) if small else table, on, how)
