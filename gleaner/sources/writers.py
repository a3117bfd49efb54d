"""Sinks.

Keyed tables are folders of versions with a commit manifest (``versions``): a lost executor, a
repeated micro-batch or a second writer cannot leave half a table or overwrite another's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import cases, reports
from gleaner.operators.keyed import distinct_first, distinct_last
from gleaner.sources import versions


def upsert(df: DataFrame, path: str, version: int | str | None = None, at: int | None = None) -> versions.Commit:
    """Add rows as one version. A ``version`` that is written again replaces its earlier self."""
    return versions.write(df, path, None if version is None else str(version), at)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Current rows: the last write per key."""
    return versions.latest(spark, path, keys, order)


def write_jobs(df: DataFrame, path: str, version: int | str | None = None, at: int | None = None) -> versions.Commit:
    """Upsert job records by ``job_id``; within one write the latest ``updated_at`` wins."""
    return upsert(distinct_last(df.withColumn("_u", F.col("updated_at")), ["job_id"], ["_u"]).drop("_u"), path, version, at)


def write_cache(df: DataFrame, path: str, version: int | str | None = None) -> versions.Commit:
    """Upsert summary-cache entries by canonical URL."""
    kept = df.filter("source_url <> ''").withColumn("_c", F.col("created_at"))
    return upsert(distinct_last(kept, ["source_url"], ["_c"]).drop("_c"), path, version)


def write_notes(df: DataFrame, path: str, version: int | str | None = None) -> versions.Commit:
    """Upsert notes by ``path``, with year and month of their capture time; within one write the latest capture wins.

    A note that is written again replaces itself: resolve the path of a known page with
    ``notes.existing_note`` first. Read with ``read_latest(spark, path, ["path"])``.
    """
    out = df.withColumns({"year": F.date_format("captured_at", "yyyy"), "month": F.date_format("captured_at", "MM"), "_c": F.col("captured_at")})
    return upsert(distinct_last(out, ["path"], ["_c"]).drop("_c"), path, version)


def write_report(results: DataFrame, path: str) -> None:
    """Case results as JSON, totals as JSON and the Markdown table as ordered text.

    The table is range-partitioned by case, so its parts are in order and no task
    holds it whole.
    """
    results.write.mode("overwrite").json(f"{path}/results")
    reports.eval_report(results).write.mode("overwrite").json(f"{path}/totals")
    lines = reports.report_lines(results).repartitionByRange("case_id").sortWithinPartitions("case_id")
    lines.select("line").write.mode("overwrite").text(f"{path}/table")


def write_sections(report: DataFrame, path: str) -> None:
    """A report of ``reports`` (section, key, part, line) as ordered text parts."""
    order = ["section", "key", "part"]  # null keys, the headings, come first
    report.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def append_auto_cases(found: DataFrame, inbox: str, version: int | str | None = None) -> versions.Commit:
    """Append automatic cases the inbox does not hold yet.

    A repeated ``version`` sees the inbox without its earlier self, so it writes the same again. Two
    writers at once may both append a case; :func:`read_inbox` returns it once.
    """
    known = versions.read(found.sparkSession, inbox)
    if known is not None and version is not None:
        own = [c.version for c in versions.live(versions.commits(found.sparkSession, inbox)) if c.token == str(version)]
        known = known.where(~F.col("_version").isin(*own)) if own else known
    return upsert(cases.new_cases(found, found.limit(0) if known is None else known), inbox, version)


def read_inbox(spark: SparkSession, inbox: str, key: str = "case_key") -> DataFrame | None:
    """Automatic cases, each (``key``, auto_reason) once: the first that came; None while there are none."""
    df = versions.read(spark, inbox)
    if df is None:
        return None
    by = {f"_by{c}": F.col(c) for c in versions.ORDER}
    return distinct_first(df.withColumns(by), [key, "auto_reason"], list(by)).drop(*by, *versions.ORDER)


def write_materials(df: DataFrame, path: str, version: int | str | None = None) -> versions.Commit:
    """Note materials as JSON, keyed by the first 12 digits of the title's SHA-1."""
    keyed = df.select(
        F.substring(F.sha1("title"), 1, 12).alias("material_key"), F.to_json(F.struct(*df.columns)).alias("materials"),
        F.col("title").alias("_t"),
    )
    return upsert(distinct_last(keyed, ["material_key"], ["_t", "materials"]).drop("_t"), path, version)


def write_indexes(edges: DataFrame, path: str, topic: str = "topic", note: str = "note") -> None:
    """Index documents: one folder per kind, rows sorted by topic and note.

    Range partitioning on both columns splits a hot topic over several files.
    """
    rows = edges.distinct()
    by = [topic, note]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy("kind") if "kind" in rows.columns else writer).parquet(path)


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of every file below a folder; count it for the summary line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"))
