"""Registry of recognition cases: keys, merge of manual and automatic cases, inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import predicates as pr
from gleaner.operators.keyed import distinct_first, keep_where

SUPPORTED_KINDS = ("url", "video_url")


def case_key(kind: Column, url: Column, raw_text: Column) -> Column:
    """Identity of a case: kind, URL and text, each collapsed."""
    return F.concat_ws("|", tx.strip(kind), tx.squash(tx.text_or_empty(url)), tx.squash(tx.text_or_empty(raw_text)))


def case_id(kind: Column, url: Column, raw_text: Column, auto_reason: Column) -> Column:
    """``auto|manual`` - slug - first 8 digits of the key's SHA-1."""
    base = F.coalesce(F.nullif(url, F.lit("")), F.nullif(raw_text, F.lit("")), kind)
    prefix = F.when(tx.text_or_empty(auto_reason) != "", F.lit("auto")).otherwise(F.lit("manual"))
    return F.concat_ws("-", prefix, tx.slugify(base), F.substring(F.sha1(case_key(kind, url, raw_text)), 1, 8))


def case_digest(kind: Column, url: Column, raw_text: Column) -> Column:
    """The key that moves in joins and groups instead of the texts: SHA-1 of the case key."""
    return F.sha1(case_key(kind, url, raw_text))


#: Columns of a registry: mergeable by :func:`merge_registries`.
REGISTRY = ("case_digest", "check", "winner", "reason", "labels")


def case_registry(df: DataFrame) -> DataFrame:
    """One row per case of a source, without its texts.

    Needs ``ord`` (position), ``provenance``, ``labels``, ``auto_reason`` and the case fields. ``winner``
    and ``reason`` carry their rank (manual before automatic, then position), ``labels`` the place
    of each label's first use, so registries merge in any order. ``check`` is a second hash of the key.
    """
    fields = [c for c in ("id", "source_kind", "source_url", "platform_hint", "provenance", "ord") if c in df.columns]
    key = case_key(F.col("source_kind"), F.col("source_url"), F.col("raw_text"))
    manual = F.when(F.col("provenance") == "manual", F.lit(0)).otherwise(F.lit(1))
    rank = F.struct(manual.alias("manual"), F.col("ord").alias("ord"))
    has_reason = tx.text_or_empty(F.col("auto_reason")) != ""
    labels = F.transform(ar.or_empty(F.col("labels")), lambda v, i: F.struct(rank.alias("rank"), i.alias("pos"), v.alias("label")))
    rows = df.select(
        F.sha1(key).alias("case_digest"), F.xxhash64(key).alias("check"), F.struct(rank.alias("rank"), *fields).alias("winner"),
        F.when(has_reason, F.struct(rank.alias("rank"), F.col("auto_reason").alias("reason"))).alias("reason"),
        F.filter(labels, lambda x: F.trim(x["label"]) != "").alias("labels"),
    )
    return merge_registries(rows)


def merge_registries(*registries: DataFrame) -> DataFrame:
    """A registry with a delta, or any number of them: what is in a registry need not be read again.

    Labels are united as distinct (case, label) rows with their first place, so a case that came in a
    million times still unites cheaply. Two keys with one digest raise an error.
    """
    union = registries[0].select(*REGISTRY)
    for other in registries[1:]:
        union = union.unionByName(other.select(*REGISTRY))
    heads = union.groupBy("case_digest").agg(
        F.min("check").alias("check"), F.max("check").alias("_other"), F.min_by("winner", "winner.rank").alias("winner"),
        F.min_by("reason", "reason.rank").alias("reason"),
    )
    same = F.when(F.col("check") == F.col("_other"), F.col("check")).otherwise(
        F.raise_error(F.concat(F.lit("two cases share the digest "), F.col("case_digest"))).cast("bigint"))
    labels = (
        union.select("case_digest", F.explode("labels").alias("l"))
        .groupBy("case_digest", "l.label")
        .agg(F.min(F.struct("l.rank", "l.pos")).alias("at"))
        .groupBy("case_digest")
        .agg(F.sort_array(F.collect_list(F.struct("at.rank", "at.pos", "label"))).alias("labels"))
    )
    kind = union.schema["labels"].dataType.simpleString()
    return heads.withColumn("check", same).join(labels, "case_digest", "left").select(
        "case_digest", "check", "winner", "reason", F.coalesce("labels", F.array().cast(kind)).alias("labels")
    )


def registry_cases(registry: DataFrame) -> DataFrame:
    """Cases of a registry: fields of the winner, labels in order of first use, first reason."""
    names = [f.name for f in registry.schema["winner"].dataType.fields if f.name != "rank"]
    return registry.select(
        "case_digest", *[F.col(f"winner.{n}").alias(n) for n in names],
        F.transform("labels", lambda e: e["label"]).alias("labels"), F.coalesce("reason.reason", F.lit("")).alias("auto_reason"),
    )


def merge_cases(*sources: DataFrame) -> DataFrame:
    """One row per case: manual beats automatic, labels are united in order. Texts stay in the sources (by ``ord``)."""
    return registry_cases(merge_registries(*[case_registry(s) for s in sources]))


def manual_first(df: DataFrame, max_cases: int = 0) -> DataFrame:
    """Manual cases first, then by id; only the first ``max_cases``, if that is above 0."""
    ordered = df.orderBy(F.when(F.col("provenance") == "manual", F.lit(0)).otherwise(F.lit(1)), "id")
    return ordered.limit(max_cases) if max_cases > 0 else ordered


def auto_cases(jobs: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Finished jobs that should become test cases, with id and reason.

    Expects ``source_kind, source_url, raw_text, platform_hint, dry_run, warnings,
    coverage, quality_score``.
    """
    reason = pr.auto_case_reason(
        F.col("source_kind"), F.col("dry_run"), F.lit(None).cast("string"), F.col("warnings"), F.col("coverage"),
        F.col("quality_score"), threshold,
    )
    found = keep_where(jobs.withColumn("auto_reason", reason), F.col("auto_reason").isNotNull())
    key = case_key(F.col("source_kind"), F.col("source_url"), F.col("raw_text"))
    ident = case_id(F.col("source_kind"), F.col("source_url"), F.col("raw_text"), F.col("auto_reason"))
    return found.withColumns({"case_key": key, "id": ident})


def new_case_ids(found: DataFrame, inbox: DataFrame, order: str) -> DataFrame:
    """(case_digest, auto_reason, ``order``) of the first case per pair that is not in the inbox. No text moves."""
    ids = _digested(found).select("case_digest", "auto_reason", order)
    fresh = distinct_first(ids, ["case_digest", "auto_reason"], [order])
    known = _digested(inbox).select("case_digest", "auto_reason").distinct()
    return fresh.join(known, ["case_digest", "auto_reason"], "left_anti")


def _digested(df: DataFrame) -> DataFrame:
    return df if "case_digest" in df.columns else df.withColumn("case_digest", F.sha1("case_key"))


def new_cases(found: DataFrame, inbox: DataFrame, order: str | None = None) -> DataFrame:
    """Cases whose (key, reason) is not in the inbox yet, once each: the first by ``order``, else the smallest row.

    Needs ``case_digest`` or ``case_key``. Joins and groups are keyed by digests.
    """
    rows = _digested(found)
    by = [order] if order else [c for c in rows.columns if c not in ("case_digest", "auto_reason")]
    known = _digested(inbox).select("case_digest", "auto_reason").distinct()
    fresh = rows.join(known, ["case_digest", "auto_reason"], "left_anti")
    keys = ["case_digest", "auto_reason"]
    return (distinct_first(fresh, keys, by) if by else fresh.dropDuplicates(keys)).select(*found.columns)
