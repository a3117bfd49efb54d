"""Summary quality: signal coverage, score, choice between candidates, media assessment."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.config import EngineConfig, RoutingConfig
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.functions.scoring import as_score, clamp01, weight_if
from gleaner.operators import profiles


def requirement_token(c: Column) -> Column:
    """Comparison form of a required value: canonical URL, lower case, collapsed."""
    return tx.squash(F.lower(urls.canonical_url(c, http_only=True)))


def signal_coverage(df: DataFrame, out: str = "coverage_check") -> DataFrame:
    """Add struct(coverage, missing): how much of what a profile requires the summary holds.

    Expects ``profile``, ``signals`` and the summary fields ``title, conclusion,
    bullets, quotes, actions``.
    """
    actions = ar.or_empty(F.col("actions"))
    corpus = F.lower(
        F.concat_ws("\n", "title", "conclusion", F.array_join("bullets", "\n"), F.array_join("quotes", "\n"),
                    F.array_join(actions, "\n"))
    )
    df = df.withColumns(
        {
            "_corpus": corpus,
            "_acts": F.lower(F.array_join(actions, "\n")),
            "_req": profiles.required_values(F.col("profile"), F.col("signals")),
        }
    )

    def first_held(kind: str) -> Column:
        return F.contains(F.col("_acts"), requirement_token(F.try_element_at(F.col("signals")[kind], F.lit(1))))

    checklist = profiles.needs_checklist(F.col("profile"))
    has_commands, has_checks = F.size("signals.commands") > 0, F.size("signals.validation_actions") > 0
    section = F.exists("bullets", lambda b: tx.starts_any(b, lx.PROJECT_BULLET_LABELS))
    checks = F.array_compact(
        F.array(
            *[
                F.when(applies, F.struct(ok.alias("ok"), F.lit(name).alias("name")))
                for applies, ok, name in (
                    (checklist, F.size(actions) >= 2, "section:执行清单"),
                    (checklist & has_commands, first_held("commands"), "actions:关键命令"),
                    (checklist & has_checks, first_held("validation_actions"), "actions:验证动作"),
                    (profiles.needs_project_section(F.col("profile")), section, "section:项目与链接"),
                )
            ]
        )
    )
    values = F.transform(
        "_req",
        lambda r: F.struct(
            F.contains(F.col("_corpus"), requirement_token(r["value"])).alias("ok"),
            F.concat(r["key"], F.lit(":"), r["value"]).alias("name"),
        ),
    )
    df = df.withColumn("_all", F.concat(values, checks))
    missing = F.transform(F.filter("_all", lambda c: ~c["ok"]), lambda c: c["name"])
    df = df.withColumn("_missing", missing)
    total = F.size("_all")
    coverage = F.when(total == 0, F.lit(1.0)).otherwise((total - F.size("_missing")) / total)
    result = F.struct(coverage.alias("coverage"), F.col("_missing").alias("missing"))
    return df.withColumn(out, result).drop("_corpus", "_acts", "_req", "_all", "_missing")


def quality_score(
    df: DataFrame,
    out: str = "quality",
    generic: Iterable[str] = lx.QUALITY_GENERIC,
    second_person: Iterable[str] = lx.SECOND_PERSON,
    weak_sources: Iterable[str] = lx.WEAK_MEDIA_SOURCES,
) -> DataFrame:
    """Add struct(score, coverage, reasons).

    Expects the output of ``signal_coverage`` and ``source_kind, text,
    evidence_sources, gate_reasons``.
    """
    missing, bullets = F.col("coverage_check.missing"), F.size("bullets")
    conclusion = tx.squash(tx.text_or_empty(F.col("conclusion")))
    actions = F.size(ar.or_empty(F.col("actions")))
    media = F.col("source_kind") == "video_url"
    size = F.length(tx.strip(tx.text_or_empty(F.col("text"))))
    gated = media & (F.size(ar.or_empty(F.col("gate_reasons"))) > 0)
    sources = ar.or_empty(F.col("evidence_sources"))
    weak = media & (F.size(sources) > 0) & (F.size(F.array_except(sources, ar.strings(*weak_sources))) == 0)
    short_media = media & (size < 180)
    lost_actions = F.exists(missing, lambda m: tx.starts_any(m, ("section:执行清单", "actions:")))
    score = (
        F.col("coverage_check.coverage")
        + F.when(bullets >= 3, F.lit(0.1)).otherwise(F.lit(-0.15))
        - as_score(F.length(conclusion) < 12, 0.1)
        - as_score(tx.contains_any(conclusion, generic), 0.25)
        - as_score(tx.contains_any(conclusion, second_person), 0.1)
        + F.when(actions >= 2, F.lit(0.05)).when(lost_actions, F.lit(-0.15)).otherwise(F.lit(0.0))
        - as_score(gated, 0.35)
        - as_score(weak, 0.15)
        - as_score(short_media, 0.1)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing_signals:"), F.array_join(ar.take(missing, 4), ","))),
            F.when(bullets < 3, F.lit("too_few_bullets")),
            F.when(F.length(conclusion) < 12, F.lit("conclusion_too_short")),
            F.when(gated, F.lit("video_incomplete")),
            F.when(weak, F.lit("video_page_snapshot_only")),
            F.when(short_media, F.lit("video_evidence_short")),
        )
    )
    result = F.struct(
        clamp01(score).alias("score"), F.col("coverage_check.coverage").alias("coverage"), reasons.alias("reasons")
    )
    return df.withColumn(out, result)


def wants_upgrade(score: Column, coverage: Column, cfg: RoutingConfig = RoutingConfig()) -> Column:
    return (score < cfg.low_quality_threshold) | (coverage < cfg.min_signal_coverage)


def choose_summary(primary: DataFrame, upgrade: DataFrame, key: str, cfg: RoutingConfig = RoutingConfig()) -> DataFrame:
    """Primary summary unless it needs an upgrade and the upgrade scores at least as well.

    Both sides hold one row per key with ``score`` and ``coverage``.
    """
    p = primary.select(key, F.col("score").alias("p_score"), F.col("coverage").alias("p_coverage"))
    u = upgrade.select(key, F.col("score").alias("u_score"))
    df = p.join(u, key, "left")
    need = wants_upgrade(F.col("p_score"), F.col("p_coverage"), cfg)
    taken = need & F.col("u_score").isNotNull() & (F.col("u_score") >= F.col("p_score"))
    return df.select(
        key,
        F.when(taken, F.lit("upgrade")).otherwise(F.lit("primary")).alias("chosen"),
        F.when(taken, F.col("u_score")).otherwise(F.col("p_score")).alias("score"),
    )


def _length_bonus(text: Column) -> Column:
    size = F.length(tx.strip(tx.text_or_empty(text)))
    return F.when(size >= 400, F.lit(2)).when(size >= 180, F.lit(1)).otherwise(F.lit(0))


def _tracks(tracks: Column, weights: dict[str, int]) -> Column:
    return sum((weight_if(F.coalesce(tracks[n], F.lit(False)), w) for n, w in weights.items()), F.lit(0))


def track_score(tracks: Column, text: Column) -> Column:
    """Evidence value of the available tracks plus a bonus for text length."""
    weights = {"has_subtitle": 2, "has_transcript": 3, "has_keyframes": 1, "has_keyframe_ocr": 1}
    return _tracks(tracks, weights) + _length_bonus(text)


def choose_recovery(current: Column, recovered: Column, min_gain: int = 120) -> Column:
    """Take the recovered evidence? Fewer reasons, else higher score, else enough more text.

    Both are structs with ``reasons``, ``track_score`` and ``text``.
    """
    now = F.length(tx.strip(tx.text_or_empty(current["text"])))
    then = F.length(tx.strip(tx.text_or_empty(recovered["text"])))
    return (
        (F.size(recovered["reasons"]) < F.size(current["reasons"]))
        | (recovered["track_score"] > current["track_score"])
        | (then >= now + max(0, min_gain))
    )


def assess_media(tracks: Column, text: Column, reasons: Column, cfg: EngineConfig = EngineConfig()) -> Column:
    """struct(level, score, text_chars) with level strong, medium or weak."""
    weights = {"has_subtitle": 3, "has_transcript": 4, "has_keyframes": 1, "has_keyframe_ocr": 1}
    score = _tracks(tracks, weights) + _length_bonus(text)
    size = F.length(tx.strip(tx.text_or_empty(text)))
    speech = F.coalesce(tracks["has_subtitle"], F.lit(False)) | F.coalesce(tracks["has_transcript"], F.lit(False))
    mute = F.exists(reasons, lambda r: F.contains(r, F.lit("missing speech track")))
    level = (
        F.when(mute & F.lit(cfg.media.require_speech_track), F.lit("weak"))
        .when((F.size(reasons) == 0) & speech, F.lit("strong"))
        .when((score >= 3) & (size >= 180), F.lit("medium"))
        .otherwise(F.lit("weak"))
    )
    return F.struct(level.alias("level"), score.alias("score"), size.alias("text_chars"))
