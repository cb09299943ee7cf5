"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only
adds the SQL settings the operators rely on (AQE, skew join, UTC) and
never overrides ``spark.checkpoint.dir`` when the cluster names one.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings every operator assumes; safe to apply to an existing session.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Joins / aggregates keyed by (graph_id, ...) reuse a partitioning on
    # graph_id alone instead of reshuffling on the full key.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def ship(module: str) -> None:
    """Pickle the functions of ``module`` by value when they go to a task, so
    that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def configure(spark: SparkSession) -> SparkSession:
    """Set the defaults above where the caller's session sets nothing."""
    chosen = spark.conf.getAll
    for k, v in SQL_DEFAULTS.items():
        if k not in chosen:
            spark.conf.set(k, v)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cwescope") -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CWESCOPE_DRIVER_MEM", "8g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        # checkpoint files of DataFrames that are no longer referenced are removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session. Only a local master may
    leave it unset; it then gets a fresh scratch folder. On a cluster each
    executor would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="cwescope-ckpt-", dir="/tmp")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage for several later uses.

    Reliable checkpoint into the shared checkpoint folder (survives executor
    loss; keeps the output partitioning, so graph-keyed joins downstream need
    no shuffle). The data is persisted first so the checkpoint write does not
    recompute the plan, and released once the checkpoint exists."""
    checkpoint_dir(df.sparkSession)
    p = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = p.checkpoint(eager=True)
    p.unpersist()
    return out


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Store ``df`` once in the shared folder, bucketed by ``key``, and read it
    back: joins, windows and aggregates whose keys include ``key`` need no
    shuffle then, whatever stands in the plan that made ``df`` (Spark forgets the
    partitioning behind a Python function). A table that is hash-partitioned by
    ``key`` into ``parts`` already is written without a shuffle, a file a task.
    The session's catalog keeps no entry; the folder is as lasting as the
    checkpoints beside it."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(parts, key)
    writer.option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return out


def kept(df: DataFrame, key: str, parts: int | None) -> DataFrame:
    """``bucketed`` if the number of parts is known, ``materialize`` if not."""
    return bucketed(df, key, parts) if parts else materialize(df)
