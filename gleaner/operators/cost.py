"""Cost ledger of media evidence and model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.config import CostConfig, EngineConfig
from gleaner.functions.scoring import call_cost_usd, token_estimate


def cost_ledger(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Add the cost columns. Expects ``text``, ``duration_seconds``, ``has_transcript``."""
    c: CostConfig = cfg.cost
    seconds = F.coalesce(F.col("duration_seconds"), F.lit(cfg.media.default_duration_minutes * 60.0))
    minutes = F.greatest(F.lit(0.0), seconds / 60.0)
    asr = F.when(F.col("has_transcript"), minutes * c.asr_usd_per_min).otherwise(F.lit(0.0))
    df = df.withColumns({"_min": minutes, "_asr": asr, "_tok": token_estimate(F.col("text"))})
    call = call_cost_usd(F.col("_tok"), F.lit(c.expected_output_tokens), c.input_usd_per_million, c.output_usd_per_million)
    df = df.withColumn("_call", call).withColumn("_usd", F.col("_asr") + F.col("_call"))
    rmb = F.col("_usd") * c.usd_cny
    return df.withColumns(
        {
            "duration_minutes": F.round("_min", 3),
            "asr_usd": F.round("_asr", 6),
            "summary_usd": F.round("_call", 6),
            "total_usd": F.round("_usd", 6),
            "total_rmb": F.round(rmb, 4),
            "over_budget": rmb > c.budget_rmb,
        }
    ).drop("_min", "_asr", "_tok", "_call", "_usd")


def ledger_totals(ledger: DataFrame, *by: str) -> DataFrame:
    grouped = ledger.groupBy(*by) if by else ledger.groupBy()
    return grouped.agg(
        F.count("*").alias("n_items"),
        F.round(F.sum("total_usd"), 6).alias("total_usd"),
        F.round(F.sum("total_rmb"), 4).alias("total_rmb"),
        F.count_if("over_budget").alias("n_over_budget"),
    )
