"""Reference-shaped tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.tables import read_table, spread

KINDS = ("pasted_text", "url", "mixed", "image", "video_url")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents", *columns))


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages", *columns))


def kind_of_source() -> Column:
    """A request kind per source name, so every kind occurs."""
    number = F.substring("source", 4, 9).cast("int") % len(KINDS)
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), number + 1)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests; the page of the same number is the source.

    Both keys are unique, so the join has no hot key.
    """
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    urls = read_table(spark, sf_dir, "pages", F.col("page_id").alias("doc_id"), F.col("url").alias("source_url"))
    joined = docs.join(urls, "doc_id", "left")
    text = F.when(F.col("source_url").isNull(), F.col("text")).otherwise(F.concat("source_url", F.lit("\n"), "text"))
    return joined.select(
        "doc_id", kind_of_source().alias("source_kind"), "source_url", "lang", "source", text.alias("text")
    )
