"""Roll-ups of case results. Every group key is small or pre-aggregated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(passed: Column, total: Column) -> Column:
    return F.round(F.when(total > 0, passed / total).otherwise(F.lit(0.0)), 4)


def _pass_total() -> list[Column]:
    return [F.count_if(F.col("passed")).alias("pass_count"), F.count("*").alias("total_count")]


def eval_report(results: DataFrame) -> DataFrame:
    """One row: case count, pass count, pass rate, total cost."""
    totals = results.agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("passed")).alias("pass_count"),
        F.round(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"),
    )
    return totals.withColumn("pass_rate", rate(F.col("pass_count"), F.col("case_count")))


def root_cause_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("root_cause").agg(F.count("*").alias("n_cases"))


def model_totals(results: DataFrame) -> DataFrame:
    """Per model: passes, totals, rate, cost and cost per round."""
    totals = results.groupBy("model").agg(
        *_pass_total(),
        F.round(F.sum("total_cost_usd"), 6).alias("total_cost_usd"),
        F.count_distinct("round").alias("rounds"),
    )
    return totals.select(
        "model",
        "pass_count",
        "total_count",
        rate(F.col("pass_count"), F.col("total_count")).alias("pass_rate"),
        "total_cost_usd",
        F.round(F.col("total_cost_usd") / F.col("rounds"), 6).alias("avg_cost_per_round_usd"),
    )


def source_kind_rollup(results: DataFrame) -> DataFrame:
    """Passes per (model, kind), per model and over all, in one pass."""
    rolled = results.rollup("model", "source_kind").agg(*_pass_total())
    return rolled.withColumn("pass_rate", rate(F.col("pass_count"), F.col("total_count")))


def case_stability(results: DataFrame) -> DataFrame:
    """Per (case, model): passes, rate and a histogram of root causes.

    Counting per root cause first leaves a handful of rows per case and model, so
    the map is small whatever the number of rounds.
    """
    per_cause = results.groupBy("case_id", "model", "root_cause").agg(*_pass_total())
    histogram = F.map_from_entries(F.sort_array(F.collect_list(F.struct("root_cause", "total_count"))))
    grouped = per_cause.groupBy("case_id", "model").agg(
        F.sum("pass_count").alias("pass_count"), F.sum("total_count").alias("total"), histogram.alias("root_causes")
    )
    return grouped.select(
        "case_id", "model", "pass_count", F.col("total").alias("total_count"),
        rate(F.col("pass_count"), F.col("total")).alias("pass_rate"), "root_causes",
    )


def unstable_cases(results: DataFrame) -> DataFrame:
    """Cases that failed at least once, by model, rate and case."""
    stable = case_stability(results)
    return stable.filter((F.col("total_count") > 0) & (F.col("pass_count") < F.col("total_count"))).orderBy(
        "model", "pass_rate", "case_id"
    )


def stage_matrix(results: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Case by stage with ``pass / score / root`` cells, ``N/A`` where a stage has no result.

    The stages are a fixed list, so the pivot needs no extra pass to find them.
    """
    cell = F.concat_ws(
        " / ", F.col("passed").cast("string"), F.col("overall_score").cast("string"), F.col("root_cause")
    )
    pivoted = results.select("case_id", "stage", cell.alias("cell")).groupBy("case_id").pivot("stage", list(stages))
    return pivoted.agg(F.first("cell")).fillna("N/A", subset=list(stages))


def run_plan(cases: DataFrame, models: Sequence[str], rounds: int) -> DataFrame:
    """rounds x models x cases, by exploding two short fixed lists per case."""
    grid = F.array(*[F.lit(m) for m in models])
    return cases.withColumn("model", F.explode(grid)).withColumn(
        "round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    )


def side_by_side(pairs: DataFrame) -> DataFrame:
    """Two result sides: pass rate, mean score and winner counts in one aggregation."""
    def side(name: str) -> list[Column]:
        return [
            F.count_if(F.col(f"{name}_passed")).alias(f"{name}_pass_count"),
            F.round(F.avg(f"{name}_score"), 4).alias(f"{name}_avg_score"),
            F.count_if(F.col("winner") == name).alias(f"{name}_wins"),
        ]

    totals = pairs.agg(
        F.count("*").alias("total_count"), *side("native"), *side("skill"),
        F.count_if(F.col("winner") == "tie").alias("ties"),
    )
    return totals.withColumns(
        {f"{n}_pass_rate": rate(F.col(f"{n}_pass_count"), F.col("total_count")) for n in ("native", "skill")}
    )


def sample_outcomes(attempts: DataFrame) -> DataFrame:
    """Per sample: did any attempt succeed, and how many did."""
    return attempts.groupBy("sample_id").agg(
        F.bool_or("ok").alias("succeeded"),
        F.count_if(F.col("ok")).alias("n_ok"),
        F.count("*").alias("n_attempts"),
    )


def report_lines(results: DataFrame) -> DataFrame:
    """Markdown table rows of a report with their order; the table itself stays distributed."""
    line = F.concat(
        F.lit("| "),
        F.concat_ws(
            " | ", "case_id", F.col("passed").cast("string"), F.col("overall_score").cast("string"), "root_cause"
        ),
        F.lit(" |"),
    )
    return results.select("case_id", line.alias("line"))


# --- report forms -----------------------------------------------------------------
#
# A report is rows of (section, key, part, line): sections in order, within a section rows by key (null: heading
# lines first), within a key by part. Each form only selects and concatenates, so a report of any number of
# cases stays distributed; ``writers.write_sections`` stores it in order.

_REPORT = ("section", "key", "part", "line")


def _rows(df: DataFrame, section: int, key: Sequence[str], line: Column, part: int = 0) -> DataFrame:
    cells = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    return df.select(F.lit(section).alias("section"), cells.alias("key"), F.lit(part).alias("part"), line.alias("line"))


def _head(df: DataFrame, section: int, *lines: str) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(section, None, i, line) for i, line in enumerate(lines)], "section int, key string, part int, line string")


def _cells(*columns: Column | str) -> Column:
    shown = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*_REPORT)
    for more in parts[1:]:
        out = out.unionByName(more.select(*_REPORT))
    return out


def stability_report(results: DataFrame, models: Sequence[str], rounds: int) -> DataFrame:
    """Models, source kinds, cases by model, and unstable cases over repeated runs.

    Needs case_id, source_kind, model, root_cause, passed and the columns of :func:`model_totals`.
    """
    totals = model_totals(results)
    kinds = source_kind_rollup(results).where("model IS NOT NULL AND source_kind IS NOT NULL")
    stable = case_stability(results)
    share = F.concat("pass_count", F.lit("/"), "total_count", F.lit(" ("), "pass_rate", F.lit(")"))
    kind_of = results.groupBy("case_id").agg(F.min("source_kind").alias("source_kind"))
    matrix = stable.groupBy("case_id").pivot("model", list(models)).agg(F.first(share)).fillna("0/0 (0.0)", subset=list(models)).join(kind_of, "case_id")
    failing = stable.where("pass_count < total_count")
    causes = F.array_join(F.transform(F.map_entries("root_causes"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ", ")
    return _union(
        _head(results, 1, "# Stability Validation Report", f"- rounds: {rounds}", "## Model Overview", "| model | pass | total | pass_rate | total_cost_usd | avg_cost_per_round |"),
        _rows(totals, 1, ["model"], _cells("model", "pass_count", "total_count", "pass_rate", "total_cost_usd", "avg_cost_per_round_usd")),
        _head(results, 2, "## Source Type Stability", "| model | source_kind | pass | total | pass_rate |"),
        _rows(kinds, 2, ["model", "source_kind"], _cells("model", "source_kind", "pass_count", "total_count", "pass_rate")),
        _head(results, 3, "## Case Stability", "| case_id | source_kind | " + " | ".join(f"{m} pass/total(rate)" for m in models) + " |"),
        _rows(matrix, 3, ["case_id"], _cells("case_id", "source_kind", *models)),
        _head(results, 4, "## Unstable Cases"),
        _rows(failing, 4, ["model", "pass_rate", "case_id"], F.concat(
            F.lit("- case="), "case_id", F.lit(" model="), "model", F.lit(" pass="), "pass_count", F.lit("/"), "total_count", F.lit(" rate="), "pass_rate",
            F.lit(" root_causes="), causes)),
    )


def progressive_report(results: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Stage totals, case by stage matrix and failing cases. Needs case_id, stage, passed, overall_score, root_cause, missing."""
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage"))
    totals = results.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("passed").alias("ok")).withColumn("at", place)
    failed = results.where(~F.col("passed")).withColumn("at", place)
    missing = F.array_join(F.col("missing"), ", ")
    return _union(
        _head(results, 1, "# Progressive Validation Report", "## Stage Summary", "| stage | case_count | pass_count | pass_rate |"),
        _rows(totals, 1, ["at"], _cells("stage", "n", "ok", rate(F.col("ok"), F.col("n")))),
        _head(results, 2, "## Case Matrix", "| case_id | " + " | ".join(f"{s} (pass/score/root)" for s in stages) + " |"),
        _rows(stage_matrix(results, stages), 2, ["case_id"], _cells("case_id", *stages)),
        _head(results, 3, "## Failing Cases"),
        _rows(failed, 3, ["at", "case_id"], F.concat("stage", F.lit(" - "), "case_id", F.lit(": "), "root_cause", F.lit(" | missing="), missing)),
    )


#: Columns of the video report after case and model.
TRUTH = ("passed", "outline_detected", "story_block_count", "workflow_hit", "risk_hit", "viewer_feedback_hit", "bullet_quality_ok", "root_cause")


def truth_report(results: DataFrame) -> DataFrame:
    """One line per case and model of a video check."""
    return _union(
        _head(results, 1, "# Video Truth Validation Report", "## Summary",
              "| case_id | model | passed | outline_detected | story_blocks | workflow | risk | feedback | bullet_quality | root_cause |"),
        _rows(results, 1, ["case_id", "model"], _cells("case_id", "model", *TRUTH)),
    )


def iterative_report(choices: DataFrame) -> DataFrame:
    """Overview, root causes and details of a baseline and a searched run.

    Needs case_id, chosen, baseline_score, searched_score, baseline_root_cause, searched_root_cause,
    case_problem_type, added_links, added_headings (arrays).
    """
    causes = choices.groupBy(F.coalesce("case_problem_type", F.lit("pass")).alias("cause")).agg(F.count("*").alias("n"))
    joined = lambda c: F.array_join(c, ", ")
    fields = {
        "chosen": F.col("chosen"), "baseline_score": F.col("baseline_score"), "searched_score": F.col("searched_score"),
        "baseline_root_cause": F.col("baseline_root_cause"), "searched_root_cause": F.col("searched_root_cause"),
        "search_helped": (F.col("chosen") == "searched").cast("string"), "added_links": joined("added_links"), "added_headings": joined("added_headings"),
    }
    details = [_rows(choices, 3, ["case_id"], F.concat(F.lit("### "), "case_id"))]
    details += [
        _rows(choices, 3, ["case_id"], F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit(""))), part)
        for part, (name, value) in enumerate(fields.items(), 1)
    ]
    return _union(
        _head(choices, 1, "# Iterative Recognition Report", "## Case Overview", "| case_id | baseline_score | searched_score | chosen | diagnosis |"),
        _rows(choices, 1, ["case_id"], _cells("case_id", "baseline_score", "searched_score", "chosen", "case_problem_type")),
        _head(choices, 2, "## Root Cause Stats"),
        _rows(causes, 2, ["cause"], F.concat(F.lit("- "), "cause", F.lit(": "), F.col("n").cast("string"))),
        _head(choices, 3, "## Details"), *details,
    )
