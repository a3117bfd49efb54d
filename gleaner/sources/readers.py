"""Readers. Rows that break a rule are split off instead of failing the job."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import cases, sampling, segments, snapshots
from gleaner.operators import lines as ln
from gleaner.operators import predicates as pr
from gleaner.sources import json_files
from gleaner.sources.json_files import read_objects
from gleaner.streaming.ledger import PHASES


class Checked(NamedTuple):
    good: DataFrame
    rejected: DataFrame


def apply_request_defaults(df: DataFrame) -> DataFrame:
    """Fill the optional request fields; a missing id becomes a UUID."""
    return df.withColumns(
        {
            "request_id": F.coalesce("request_id", F.uuid()),
            "image_refs": ar.or_empty(F.col("image_refs")),
            "requested_output_lang": F.coalesce("requested_output_lang", F.lit("zh-CN")),
            "dry_run": F.coalesce("dry_run", F.lit(False)),
            "force_full_video": F.coalesce("force_full_video", F.lit(False)),
        }
    )


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Ingest payloads, one JSON object per line."""
    return apply_request_defaults(spark.read.schema(schemas.REQUEST).json(path))


def _filled(arr: Column) -> Column:
    return F.filter(ar.or_empty(arr), lambda x: tx.strip(x) != "")


def clean_expect(expect: Column) -> Column:
    """Expectation without blank items; the minimum length is at least 1, 80 by default."""
    lists = [n.split(" ")[0] for n in schemas.EXPECT.split(", ") if "ARRAY" in n]
    minimum = F.greatest(F.lit(1), F.coalesce(expect["min_evidence_chars"], F.lit(80)))
    return F.struct(
        *[_filled(expect[n]).alias(n) for n in lists],
        F.coalesce(expect["require_action_checklist"], F.lit(False)).alias("require_action_checklist"),
        minimum.alias("min_evidence_chars"),
    )


def read_eval_cases(spark: SparkSession, path: str) -> Checked:
    """Evaluation cases from JSON arrays; rows without id or kind are rejected."""
    df = read_objects(spark, path, schemas.EVAL_CASE).drop("_path", "_ord")
    ident = tx.strip(F.coalesce(F.nullif("id", F.lit("")), F.col("case_id"), F.lit("")))
    kind = tx.strip(tx.text_or_empty(F.col("source_kind")))
    df = df.withColumns(
        {
            "case_id": ident,
            "source_kind": kind,
            "image_refs": _filled(F.col("image_refs")),
            "force_full_video": F.coalesce("force_full_video", F.lit(False)),
            "expect": clean_expect(F.col("expect")),
        }
    ).drop("id")
    reason = F.when(F.col("case_id") == "", F.lit("missing id")).when(F.col("source_kind") == "", F.lit("missing source_kind"))
    df = df.withColumn("reject_reason", reason)
    return Checked(df.filter("reject_reason IS NULL").drop("reject_reason"), df.filter("reject_reason IS NOT NULL"))


def read_recognition_cases(spark: SparkSession, path: str, provenance: str) -> Checked:
    """Recognition cases: a JSON array or one object per line; ``ord`` is the place in the file.

    A case without an id gets one from its normalised reason, which is never empty,
    so such an id starts with ``auto-`` even in a manual file.
    """
    df = read_objects(spark, path, schemas.RECOGNITION_CASE)
    df = df.withColumns(
        {
            "provenance": F.coalesce(F.nullif(tx.strip(F.col("provenance")), F.lit("")), F.lit(provenance)),
            "auto_reason": pr.normalize_reason(F.col("auto_reason")),
            "labels": ar.keep_first(F.col("labels")),
            "expect": clean_expect(F.col("expect")),
        }
    ).drop("_path").withColumnRenamed("_ord", "ord")
    derived = cases.case_id(F.col("source_kind"), F.col("source_url"), F.col("raw_text"), F.col("auto_reason"))
    given = [F.nullif(tx.strip(F.col(c)), F.lit("")) for c in ("id", "case_id")]
    df = df.withColumn("id", F.coalesce(*given, derived)).drop("case_id")
    df = df.withColumn("auto_reason", F.when(F.col("provenance") == "auto", F.col("auto_reason")).otherwise(F.lit("")))
    supported = F.coalesce(F.col("source_kind").isin(*cases.SUPPORTED_KINDS), F.lit(False))
    return Checked(df.filter(supported), df.filter(~supported))


def read_replay_cases(spark: SparkSession, path: str) -> DataFrame:
    """Saved payloads with their context and expectation, flattened; ``path`` and ``ord`` give their order."""
    df = read_objects(spark, path, schemas.REPLAY_CASE)
    return apply_request_defaults(
        df.select(F.col("_path").alias("path"), F.col("_ord").alias("ord"), "case_id", "entry_context.chat_target", "entry_context.entry_mode", "payload.*", clean_expect(F.col("expect")).alias("expect"))
    )


def frontmatter_value(content: Column, key: str) -> Column:
    """Value of ``key:`` in the first ``---`` block, empty when there is none."""
    block = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---\n", 1)
    return tx.strip(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1))


def parse_notes(df: DataFrame, content: str = "content", path: str = "path", topics_root: str = "Topics", evidence: str = "原始证据") -> DataFrame:
    """Note fields from whole Markdown texts."""
    c = F.col(content)
    stem = F.regexp_extract(F.col(path), r"([^/]+)\.md$", 1)
    old = F.regexp_extract(c, r"<!--\s*source_url:\s*(https?://\S+)\s*-->", 1)
    url = frontmatter_value(c, "source_url")
    topics = F.regexp_extract_all(c, F.lit(rf"\[\[{topics_root}/([^/\]]+)/[^\]]*Index\.md"), 1)
    section = ln.section_slice(F.split(c, tx.LINE_BREAK), f"## {evidence}")
    return df.select(
        path,
        F.coalesce(F.nullif(frontmatter_value(c, "title"), F.lit("")), stem).alias("title"),
        F.when(url != "", url).otherwise(old).alias("source_url"),
        *[frontmatter_value(c, k).alias(k) for k in ("source_kind", "platform", "captured_at", "content_profile", "keyword_l1", "keyword_l2")],
        tx.strip(F.array_join(section, "\n")).alias("raw_evidence"),
        F.array_sort(F.array_distinct(topics)).alias("topic_names"),
    )


def read_notes(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """All Markdown notes below a folder, archives left out."""
    files = spark.read.text(root, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    raw = files.select(F.col("value").alias("content"), F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"))
    return parse_notes(raw.filter(~F.contains("path", F.lit("/_Archive/"))), **options)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job ledger files with missing tracking fields filled in."""
    df = spark.read.schema(schemas.JOB).json(path, multiLine=True)
    blank = F.create_map(*[F.lit(x) for p in PHASES for x in (p, "pending")])
    known = F.coalesce("phase_status", F.create_map().cast("map<string,string>"))
    note = F.col("notification")
    return df.withColumns(
        {
            "phase_status": F.map_concat(F.map_filter(blank, lambda k, _: ~F.map_contains_key(known, k)), known),
            "warnings": ar.or_empty(F.col("warnings")),
            "notification": F.struct(F.coalesce(note["attempted"], F.lit(False)).alias("attempted"), note["ok"].alias("ok"), note["error"].alias("error")),
        }
    )


def read_vtt(spark: SparkSession, path: str, max_seconds: float = 0.0) -> DataFrame:
    """(path, ord, start, end, text) cues of WebVTT files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = ar.explode_rows(files, "path", segments.vtt_segments(F.col("value"), max_seconds), "s")
    return rows.select("path", "ord", "s.*")


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return snapshots.read_lines(files, "path", "value")


def harvest_urls(spark: SparkSession, json_paths: list[str], prose_paths: list[str]) -> DataFrame:
    """(source_url, source_kind) pairs from JSON of any nesting, and URLs from prose files."""
    parts = []
    if json_paths:
        raw = spark.read.text(json_paths, wholetext=True)
        parts.append(json_files.harvest(raw, "value"))
    if prose_paths:
        text = spark.read.text(prose_paths)
        found = ar.explode_rows(text, [], sampling.prose_urls(F.col("value")), "source_url")
        parts.append(found.select("source_url", F.lit(None).cast("string").alias("source_kind")))
    union = parts[0]
    for other in parts[1:]:
        union = union.unionByName(other)
    return union
