"""Table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Parquet table ``name`` of a data folder, optionally reduced to some columns."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan has fewer splits than the cluster has cores.

    Text rules are CPU-bound. A table in one small file is one task; only then the
    rows are dealt out evenly. Large tables have more splits and stay untouched. Only
    call this on a scan: counting the splits of a join would run it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
