"""Content profiles and the signal values a profile asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx


def infer_profile(
    kind: Column, url: Column, text: Column, signals: Column, has_steps: Column,
    lexicon: lx.ProfileLexicon = lx.ProfileLexicon(),
) -> Column:
    """video > skill > install > project > general."""
    low = F.lower(tx.text_or_empty(text))

    def some(name: str) -> Column:
        return F.size(signals[name]) > 0

    skill = some("skills") | some("skill_ids") | tx.contains_any(low, lexicon.skill)
    install = some("commands") | has_steps | tx.contains_any(low, lexicon.install)
    project = (
        some("projects")
        | tx.contains_any(F.lower(tx.text_or_empty(url)), lexicon.project_hosts)
        | tx.contains_any(low, lexicon.project)
    )
    return (
        F.when(kind == "video_url", F.lit("video_explainer"))
        .when(skill, F.lit("skill_recommendation"))
        .when(install, F.lit("installation_tutorial"))
        .when(project, F.lit("project_overview"))
        .otherwise(F.lit("general_capture"))
    )


def needs_checklist(profile: Column) -> Column:
    return profile.isin(*lx.PROFILES_WITH_CHECKLIST)


def needs_project_section(profile: Column) -> Column:
    return profile.isin(*lx.PROFILES_WITH_PROJECT_SECTION)


def required_values(profile: Column, signals: Column) -> Column:
    """array<struct<key,value>>: first value of every signal kind the profile requires.

    Links prefer a page over a raw file. The profile table has five fixed rows, so
    the lookup is an expression instead of a join.
    """
    order = ("projects", "links", "skills", "skill_ids", "commands")

    def first(name: str) -> Column:
        values = signals[name]
        if name == "links":
            pages = F.filter(
                values, lambda u: ~F.contains(F.lower(u), F.lit("/raw/")) & ~F.endswith(F.lower(u), F.lit(".skill"))
            )
            values = F.when(F.size(pages) > 0, pages).otherwise(values)
        return tx.strip(F.try_element_at(values, F.lit(1)))

    entries = []
    for name in order:
        profiles = [p for p, keys in lx.PROFILE_REQUIRED.items() if name in keys]
        value = F.when(profile.isin(*profiles), first(name))
        entries.append(F.when(tx.text_or_empty(value) != "", F.struct(F.lit(name).alias("key"), value.alias("value"))))
    return F.array_compact(F.array(*entries))


def key_list(profile: Column, table: dict[str, tuple[str, ...]]) -> Column:
    expr = ar.empty_strings()
    for name, keys in table.items():
        if keys:
            expr = F.when(profile == name, ar.strings(*keys)).otherwise(expr)
    return expr


def finalize_evidence(df: DataFrame, has_steps: Column | None = None) -> DataFrame:
    """Add profile, requirements and a distinct source list to an evidence table.

    Expects ``source_kind``, ``source_url``, ``text``, ``signals`` and
    ``evidence_sources``.
    """
    steps = has_steps if has_steps is not None else F.lit(False)
    df = df.withColumn(
        "profile",
        infer_profile(F.col("source_kind"), F.col("source_url"), F.col("text"), F.col("signals"), steps),
    )
    profile = F.col("profile")
    return df.withColumns(
        {
            "requirements": F.struct(
                profile.alias("kind"),
                key_list(profile, lx.PROFILE_REQUIRED).alias("required_keys"),
                key_list(profile, lx.PROFILE_OPTIONAL).alias("optional_keys"),
                required_values(profile, F.col("signals")).alias("required_values"),
                needs_checklist(profile).alias("require_action_checklist"),
                needs_project_section(profile).alias("require_project_section"),
            ),
            "evidence_sources": ar.keep_first(F.col("evidence_sources")),
        }
    )
