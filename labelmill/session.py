"""Session settings and durable cuts of lineage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, name: str = "labelmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one spark.checkpoint.dir names, else one in the warehouse.

    Both are folders that every executor can reach; nothing is written to a machine's own temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written copy.

    The copy survives the loss of executors; use it where a result is read many times.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows as a local relation, whose exact size Spark knows when it picks a join."""
    fields = T.StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[] for _ in fields]
    table = pa.table({f.name: list(column) for f, column in zip(fields, columns)})
    return spark.createDataFrame(table, schema=fields)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan evened out over tasks, the same plan at every size.

    A table of few row groups would otherwise be parsed by few tasks. Where tables come in many files, set
    `spark.labelmill.rebalance` to false and the scan is left as it is.
    """
    wanted = df.sparkSession.conf.get("spark.labelmill.rebalance", "true") == "true"
    return df.hint("rebalance") if wanted else df
