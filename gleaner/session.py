"""Session construction and checkpoint placement."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs rely on. All of them are plain SQL options, so a cluster
#: that already owns a session only has to set these.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture makes building large expressions several times slower.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the options above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared checkpoint folder of the cluster, or ``fallback`` where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or fallback


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves a local master; a cluster must set it.
    """
    root = checkpoint_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-gleaner-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, fallback: str | None = None) -> DataFrame:
    """Reliable checkpoint into the shared folder; a no-op when there is none."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark, fallback)
    if folder is None:
        return df
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(folder, "gleaner"))
    return df.checkpoint(eager=True)


def apply_defaults(spark: SparkSession) -> None:
    """Set the options on a session that somebody else built."""
    for key, value in SQL_DEFAULTS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
