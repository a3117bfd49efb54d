"""Small numeric expressions shared by scores and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions import text as tx


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def token_estimate(c: Column) -> Column:
    """1.05 tokens per non-blank character, at least 1 for non-empty text."""
    size = F.length(tx.drop_space(tx.text_or_empty(c)))
    estimate = F.greatest(F.floor(size * F.lit(1.05)).cast("long"), F.lit(1).cast("long"))
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(estimate)


def call_cost_usd(tokens_in: Column, tokens_out: Column, usd_in: float, usd_out: float) -> Column:
    million = F.lit(1_000_000.0)
    return tokens_in / million * F.lit(usd_in) + tokens_out / million * F.lit(usd_out)


def as_score(flag: Column, weight: float) -> Column:
    return F.when(flag, F.lit(float(weight))).otherwise(F.lit(0.0))


def weight_if(flag: Column, weight: int) -> Column:
    return F.when(flag, F.lit(weight)).otherwise(F.lit(0))
