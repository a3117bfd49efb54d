"""Candidate URLs: harvest, classify and sample with quotas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import predicates as pr
from gleaner.operators.keyed import distinct_first, top_per_key

PROSE_URL = r"https?://[^\s)>\]\"']+"


def clean_raw_url(c: Column) -> Column:
    """Trim back ticks; add a scheme when the text looks like a host name."""
    v = tx.strip(tx.strip(tx.strip(tx.text_or_empty(c)), "`"))
    return tx.let(
        v,
        lambda u: F.when(
            (u != "") & ~tx.starts_any(u, ("http://", "https://")) & u.rlike(r"[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
            F.concat(F.lit("https://"), F.ltrim(u, F.lit("/"))),
        ).otherwise(u),
    )


def prose_urls(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(tx.text_or_empty(text), F.lit(PROSE_URL), 0), lambda u: tx.rstrip(u, ".,`"))


def candidates(urls_df: DataFrame, allow: Iterable[str] = lx.SAMPLING_DOMAINS, assets: Iterable[str] = lx.ASSET_TOKENS,
               doc_hosts: Iterable[str] = lx.DOC_HOSTS) -> DataFrame:
    """Canonical candidate URLs with kind, family and bucket, each URL once.

    Expects ``source_url`` and optionally ``source_kind``.
    """
    explicit = F.col("source_kind") if "source_kind" in urls_df.columns else F.lit(None).cast("string")
    canonical = urls.canonical_url(clean_raw_url(F.col("source_url")), (*lx.TRACKING_KEYS, *lx.SAMPLING_EXTRA_KEYS))
    df = urls_df.select(canonical.alias("source_url"), explicit.alias("_explicit"))
    df = df.filter(pr.is_candidate_url(F.col("source_url"), allow, assets)).dropDuplicates(["source_url"])
    df = df.withColumn("source_kind", urls.source_kind(F.col("source_url"), F.col("_explicit"))).drop("_explicit")
    return df.withColumns(
        {
            "family": urls.family(F.col("source_url"), doc_hosts),
            "bucket": urls.bucket(F.col("source_url"), F.col("source_kind"), doc_hosts),
        }
    )


def sample_candidates(df: DataFrame, sample_size: int, max_per_family: int) -> DataFrame:
    """One candidate per bucket, then more by class and URL, under a quota per family.

    Everything is ordered by (class, url), so the result is fixed. Only the first
    ``max_per_family`` rows of a family can ever be taken by the second round plus
    one per bucket in the first; both limits apply before rows leave their tasks.
    """
    usable = df.filter(F.col("classification").isin("successful", "partial_but_usable"))
    usable = usable.withColumn("_class", F.when(F.col("classification") == "successful", F.lit(0)).otherwise(F.lit(1)))
    by_rank = [F.col("_class").asc(), F.col("source_url").asc()]
    # First round: the best of every bucket, in bucket order, while its family has room.
    heads = distinct_first(usable.withColumns({"_c": F.col("_class"), "_u": F.col("source_url")}), ["bucket"], ["_c", "_u"])
    first = top_per_key(heads.drop("_c", "_u"), ["family"], [F.col("bucket").asc()], max_per_family).drop("rank")
    first = first.withColumn("_round", F.lit(0))
    taken = first.groupBy("family").agg(F.count("*").alias("_taken"))
    total = first.agg(F.count("*").alias("_total"))
    # Second round: what is left, as far as family quota and sample size allow.
    rest = usable.join(first.select("source_url"), "source_url", "left_anti")
    rest = top_per_key(rest, ["family"], by_rank, max_per_family)
    rest = rest.join(taken, "family", "left").filter(F.col("rank") + F.coalesce("_taken", F.lit(0)) <= max_per_family)
    # A distributed top-k leaves sample_size rows; only those are numbered. The single
    # total is attached by key, so no cross product is formed.
    best = rest.orderBy(*by_rank).limit(sample_size).withColumn("_one", F.lit(1))
    room = best.join(total.withColumn("_one", F.lit(1)), "_one").withColumn(
        "_n", F.row_number().over(Window.partitionBy("_one").orderBy(*by_rank))
    )
    second = room.filter(F.col("_n") + F.col("_total") <= sample_size).withColumn("_round", F.lit(1))
    keep = [c for c in df.columns]
    both = first.select(*keep, "_round").unionByName(second.select(*keep, "_round"))
    return both.withColumnRenamed("_round", "round")
