"""Job and phase ledger over phase events, batch and streaming.

A phase event is (job_id, seq, phase, state, warning). Events are first reduced to *parts*,
one row per (job, phase, warning), which merge by sums and maxima. A batch merges the parts of
all its events; the stream keeps the parts of every micro-batch and merges them on reading, so
both follow one rule, a busy job never meets in one task event by event, and a repeated
micro-batch replaces its own parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gleaner.sources import versions, writers

#: Phases of a job and states of a phase.
PHASES = ("extract", "summarize", "write_note", "notify")
STATES = ("pending", "processing", "done", "failed", "skipped")


def job_status(last_state: Column, n_warnings: Column) -> Column:
    return (
        F.when(last_state == "failed", F.lit("failed"))
        .when(last_state.isin("pending", "processing"), F.lit("processing"))
        .when(n_warnings > 0, F.lit("completed_with_warnings"))
        .otherwise(F.lit("done"))
    )


def ledger_parts(events: DataFrame) -> DataFrame:
    """(job_id, phase, warning, n, last, first_seq): what is to be known of a set of events."""
    return events.groupBy("job_id", "phase", "warning").agg(
        F.count("*").alias("n"), F.max(F.struct("seq", "phase", "state")).alias("last"), F.min("seq").alias("first_seq")
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per job: n_events, status, phases, warnings in order of appearance, failed_phase.

    Phases that saw no event stay ``pending``.
    """
    by_phase = parts.groupBy("job_id", "phase").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    jobs = by_phase.groupBy("job_id").agg(
        F.sum("n").alias("n_events"), F.max("last").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("phase", "last.state"))).alias("_seen"),
    )
    by_warning = parts.filter(F.coalesce("warning", F.lit("")) != "").groupBy("job_id", "warning").agg(F.min("first_seq").alias("at"))
    warned = by_warning.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("at", "warning"))).alias("_w"))
    blank = F.create_map(*[F.lit(x) for p in PHASES for x in (p, "pending")])
    seen = F.col("_seen")
    phases = F.map_concat(F.map_filter(blank, lambda k, _: ~F.map_contains_key(seen, k)), seen)
    warnings = F.coalesce(F.transform("_w", lambda e: e["warning"]), F.array().cast("array<string>"))
    jobs = jobs.join(warned, "job_id", "left").withColumn("warnings", warnings)
    return jobs.select(
        "job_id",
        "n_events",
        job_status(F.col("last.state"), F.size("warnings")).alias("status"),
        phases.alias("phases"),
        "warnings",
        F.when(F.col("last.state") == "failed", F.col("last.phase")).alias("failed_phase"),
    )


def final_ledger(events: DataFrame) -> DataFrame:
    """The ledger of a table of events."""
    return merge_parts(ledger_parts(events))


def stream_ledger(events: DataFrame, path: str) -> DataStreamWriter:
    """Keep the parts of every micro-batch of an event stream below ``path``; set trigger and checkpoint, then start."""
    return events.writeStream.foreachBatch(lambda batch, number: writers.upsert(ledger_parts(batch), path, number))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of all events that :func:`stream_ledger` has seen."""
    return merge_parts(versions.read(spark, path))
