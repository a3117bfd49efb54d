"""Streaming ingest: queue, upsert, replay and cache check."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner import schemas
from gleaner.config import CacheConfig
from gleaner.functions import urls
from gleaner.operators.keyed import number_rows
from gleaner.session import run_folder
from gleaner.sources import versions
from gleaner.sources.readers import apply_request_defaults
from gleaner.sources.writers import upsert
from gleaner.streaming.ledger import PHASES


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Payload files as they arrive."""
    reader = spark.readStream.schema(schemas.REQUEST)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return apply_request_defaults(reader.json(folder))


def queued_jobs(requests: DataFrame) -> DataFrame:
    """Accepted requests as job records in their first state."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return requests.select(
        F.col("request_id").alias("job_id"),
        F.lit("received").alias("status"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.lit("queued").alias("message"),
        F.struct(*requests.columns).alias("request"),
        F.create_map(*[F.lit(x) for p in PHASES for x in (p, "pending")]).alias("phase_status"),
        F.array().cast("array<string>").alias("warnings"),
    )


def upsert_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write every micro-batch as one version of a keyed table.

    A batch that is repeated after a failure replaces its own version and nothing else.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, path, version=f"{checkpoint}#{batch_id}")

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_job_stream(df: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a batch job on each micro-batch and append its rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert(job(batch), path, version=f"{checkpoint}#{batch_id}")

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, folder: str, job: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Process everything in a folder of saved payloads in any order, then stop."""
    return batch_job_stream(request_stream(spark, folder), job, path, checkpoint)


def admit(payloads: DataFrame, order: Sequence[str], limit: int = 0) -> DataFrame:
    """Payloads with ``seq``, their place in ``order`` from 0; only the first ``limit`` of all, if that is above 0.

    ``order`` should be total, else ties are numbered in any order.
    """
    if limit > 0:
        first = payloads.orderBy(*order).limit(limit)
        return first.withColumn("seq", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return number_rows(payloads, order)


def replay_in_order(
    payloads: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, order: Sequence[str], limit: int = 0,
    per_batch: int = 1000, name: str = "replay",
) -> int:
    """Run ``job`` on batches of ``per_batch`` payloads in order and commit each as a version; returns the batches run.

    Call again after a stop: batches that are committed are not repeated, the others run in the same order.
    The input must be the same then. ``limit`` as in :func:`admit`.
    """
    spark = payloads.sparkSession
    folder = f"{run_folder(spark, name)}/admitted"
    admit(payloads, order, limit).withColumn("_batch", F.floor(F.col("seq") / per_batch)).write.parquet(folder)
    admitted = spark.read.parquet(folder)
    finished = {c.token for c in versions.commits(spark, path)}
    batches = admitted.agg(F.max("_batch")).first()[0]
    ran = 0
    for k in range(0 if batches is None else batches + 1):
        if f"{name}#{k}" not in finished:
            versions.write(job(admitted.where(F.col("_batch") == k).drop("_batch")), path, f"{name}#{k}", at=k)
            ran += 1
    return ran


def fresh_cache_hits(requests: DataFrame, cache: DataFrame, cfg: CacheConfig = CacheConfig(), now: Column | None = None) -> DataFrame:
    """Stream-static join with the cache: entries within the TTL at ``now`` (the current time), one row per URL in the cache.

    ``state.cached_lookups`` answers by the time of each request instead.
    """
    entries = cache.select(
        F.col("source_url").alias("_key"),
        F.col("created_at").cast("timestamp").alias("_at"),
        F.col("fingerprint").alias("_fp"),
        F.col("summary").alias("_summary"),
    )
    keyed = requests.withColumn("_key", urls.canonical_url(F.col("source_url")))
    joined = keyed.join(entries, "_key", "left")
    age = F.unix_micros(F.current_timestamp() if now is None else now) - F.unix_micros("_at")
    fresh = age <= max(1, cfg.ttl_hours) * 3_600_000_000
    return joined.withColumns(
        {"fingerprint": F.when(fresh, F.col("_fp")), "summary": F.when(fresh, F.col("_summary"))}
    ).drop("_key", "_at", "_fp", "_summary")
