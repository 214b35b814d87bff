"""Session set-up and shared storage for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session options every plan relies on."""
    for key, value in _RUNTIME_CONF.items():
        spark.conf.set(key, value)
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster.

    Only a local session, where driver and executors share one disk, may fall
    back to a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path inside the shared folder."""
    return f"{checkpoint_root(spark)}/riskweave-{uuid.uuid4().hex}/{label}"


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Materialise ``df`` in shared storage and drop its lineage.

    With ``keep_layout`` the result keeps the partitioning and order of its
    last step, so later joins on those keys need no shuffle. Spark knows that
    layout only for a plan it does not change while it runs.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    if not keep_layout:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back; its lineage ends there."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after a
    large step has ended.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
