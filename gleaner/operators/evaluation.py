"""Expectation scoring per case, overall score, root cause and phrase matching."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import lexicons as lx
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions.scoring import as_score, clamp01
from gleaner.operators import lines as ln

#: Expectation lists of a case and the label of their items.
REQUIRED_LABELS = {
    "required_keywords": "keyword", "required_links": "link", "required_projects": "project",
    "required_skill_ids": "skill_id", "required_skills": "skill", "required_actions": "action",
}
SIGNAL_LABELS = ("project", "link", "skill_id", "skill")
SIGNAL_TEXT_KINDS = ("projects", "links", "skills", "skill_ids", "commands", "hashtags")


def required_items(expect: Column) -> Column:
    """array<struct<label,value>> of every required item of an expectation."""

    def labelled(values: Column, label: str) -> Column:
        return F.transform(ar.or_empty(values), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    return F.concat(*[labelled(expect[name], label) for name, label in REQUIRED_LABELS.items()])


def holds(corpus: Column, value: Column) -> Column:
    """Token comparison: both sides collapsed and lower-cased; ``corpus`` already is."""
    return F.contains(corpus, tx.token(value))


def missing_items(corpus: Column, required: Column) -> Column:
    return F.transform(
        F.filter(required, lambda r: ~holds(corpus, r["value"])), lambda r: F.concat(r["label"], F.lit(":"), r["value"])
    )


def recall(required: Column, missing: Column) -> Column:
    """Hits over required items, 1 when nothing is required."""
    return F.when(F.size(required) == 0, F.lit(1.0)).otherwise(1.0 - F.size(missing) / F.size(required))


def forbidden_hits(corpus: Column, phrases: Column, extra: Iterable[str] = ()) -> Column:
    return F.filter(F.concat(ar.or_empty(phrases), ar.strings(*extra)), lambda p: holds(corpus, p))


def signals_text(signals: Column) -> Column:
    return F.array_join(F.concat(*[signals[k] for k in SIGNAL_TEXT_KINDS]), "\n")


def _step(score: Column, passed: Column, missing: Column, forbidden: Column | None = None) -> Column:
    return F.struct(
        score.alias("score"),
        passed.alias("passed"),
        missing.alias("missing"),
        (forbidden if forbidden is not None else ar.empty_strings()).alias("forbidden_hits"),
    )


def _scored(score: Column, missing: Column, forbidden: Column, threshold: float) -> Column:
    return tx.let(
        score,
        lambda s: _step(s, (s >= threshold) & (F.size(missing) == 0) & (F.size(forbidden) == 0), missing, forbidden),
    )


def score_steps(df: DataFrame) -> DataFrame:
    """Add the four step structs to case rows.

    Expects ``required`` (array of label and value), ``forbidden`` (array),
    ``min_evidence_chars``, ``require_action_checklist``, ``evidence_text``,
    ``signal_values`` (array), the summary fields ``title, conclusion, bullets,
    quotes, actions`` and ``note``. One case is one row, so scoring is a narrow map.

    Phrases are looked for in the joined summary. A conclusion that is the title, or actions that are the
    bullets, are left out there: no phrase may be found where a text's end meets its own start.
    """
    required, forbidden = F.col("required"), F.col("forbidden")
    evidence = tx.squash(tx.text_or_empty(F.col("evidence_text")))
    signal_corpus = F.array_join("signal_values", "\n")
    actions = ar.or_empty(F.col("actions"))
    said, done = F.array_join("bullets", "\n"), F.array_join(actions, "\n")
    summary = F.concat_ws("\n", "title", F.nullif("conclusion", "title"), said, F.array_join("quotes", "\n"), F.nullif(done, said))
    df = df.withColumns(
        {
            "_ev": evidence,
            "_ev_key": tx.token(F.concat(evidence, F.lit("\n"), signal_corpus)),
            "_sig_key": tx.token(signal_corpus),
            "_sum_key": tx.token(summary),
            "_note_key": tx.token(F.col("note")),
            "_wanted": F.filter(required, lambda r: r["label"].isin(*SIGNAL_LABELS)),
        }
    )
    df = df.withColumns(
        {
            "_m_ev": missing_items(F.col("_ev_key"), required),
            "_m_sig": F.transform(
                F.filter("_wanted", lambda r: ~holds(F.col("_sig_key"), r["value"])), lambda r: r["value"]
            ),
            "_m_sum": missing_items(F.col("_sum_key"), required),
            "_m_note": missing_items(F.col("_note_key"), required),
            "_f_sum": forbidden_hits(F.col("_sum_key"), forbidden, lx.SUMMARY_FORBIDDEN),
            "_f_note": forbidden_hits(F.col("_note_key"), forbidden, lx.NOTE_FORBIDDEN),
            "_unique": ln.unique_ratio(F.col("note")),
        }
    )
    none = ar.empty_strings()
    minimum = F.greatest(F.col("min_evidence_chars"), F.lit(1))
    length = F.least(F.lit(1.0), F.length("_ev") / minimum)
    extract = 0.35 * length + 0.65 * recall(required, F.col("_m_ev"))

    no_signal_case = as_score(F.size("signal_values") > 0, 1.0)
    bare = F.greatest(no_signal_case, F.lit(0.85))
    signal = F.when(F.size("_wanted") == 0, bare).otherwise(recall(F.col("_wanted"), F.col("_m_sig")))

    penalty = F.least(F.lit(0.5), 0.2 * F.size("_f_sum"))
    summary_score = F.greatest(F.lit(0.0), recall(required, F.col("_m_sum")) - penalty)
    for flaw, cost in (
        (F.size("bullets") < 3, 0.15),
        (F.length(tx.squash(tx.text_or_empty(F.col("conclusion")))) < 12, 0.15),
        (F.col("require_action_checklist") & (F.size(actions) < 2), 0.2),
    ):
        summary_score = F.greatest(F.lit(0.0), summary_score - as_score(flaw, cost))

    low_unique = F.col("_unique") < 0.72
    duplication = F.when(low_unique, F.least(F.lit(0.35), (0.72 - F.col("_unique")) * 0.8)).otherwise(F.lit(0.0))
    note_length = F.least(F.lit(1.0), F.length(tx.squash(tx.text_or_empty(F.col("note")))) / 240)
    note_score = F.greatest(
        F.lit(0.0),
        0.55 * recall(required, F.col("_m_note"))
        + 0.30 * note_length
        + 0.15 * F.col("_unique")
        - duplication
        - F.least(F.lit(0.4), 0.2 * F.size("_f_note")),
    )
    no_procedure = F.col("require_action_checklist") & ~tx.contains_any(F.col("note"), lx.NOTE_ACTION_TOKENS)
    note_missing = F.concat(
        F.col("_m_note"), F.when(no_procedure, ar.strings("action:expected_procedure")).otherwise(none)
    )
    df = df.withColumns(
        {
            "extract_step": _scored(extract, F.col("_m_ev"), none, 0.75),
            "signals_step": _scored(signal, F.col("_m_sig"), none, 0.8),
            "summary_step": _scored(summary_score, F.col("_m_sum"), F.col("_f_sum"), 0.75),
            "note_step": _scored(note_score, note_missing, F.col("_f_note"), 0.7),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_")])


STEPS = ("extract_step", "signals_step", "summary_step", "note_step")
WEIGHTS = {"extract_step": 0.35, "signals_step": 0.20, "summary_step": 0.30, "note_step": 0.15}


def overall(df: DataFrame, iterative: bool = False) -> DataFrame:
    """Add overall score, pass flag, root cause and the united missing/forbidden lists.

    A judge may contribute a quarter of the score through the optional columns
    ``judge_score`` and ``judge_root_cause``. The iterative variant subtracts for
    warnings (``warning_count``), passes at 0.72 and ignores missing items.
    """
    for name, default in (("judge_score", "double"), ("judge_root_cause", "string"), ("summary_error", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(default))
    base = sum((F.col(s)["score"] * w for s, w in WEIGHTS.items()), F.lit(0.0))
    missing = F.array_distinct(F.concat(*[F.col(s)["missing"] for s in STEPS]))
    forbidden = F.array_distinct(F.concat(*[F.col(s)["forbidden_hits"] for s in STEPS]))
    if iterative:
        total = F.greatest(F.lit(0.0), base - F.least(F.lit(0.25), 0.05 * F.col("warning_count")))
    else:
        judged = base * 0.75 + F.col("judge_score") * 0.25
        total = F.when(F.col("judge_score").isNotNull(), judged).otherwise(base)
    df = df.withColumns({"_total": total, "missing": missing, "forbidden_hits": forbidden})
    clean = F.size("forbidden_hits") == 0
    if iterative:
        passed = (F.col("_total") >= 0.72) & clean
    else:
        judge_ok = F.col("judge_score").isNull() | (
            (F.col("judge_score") >= 0.72) & (F.col("judge_root_cause") == "pass")
        )
        passed = (
            (F.col("_total") >= 0.78)
            & clean
            & (F.size("missing") == 0)
            & (tx.text_or_empty(F.col("summary_error")) == "")
            & judge_ok
        )
    df = df.withColumns({"overall_score": F.round("_total", 4), "passed": passed, "root_cause": root_cause(df)})
    return df.withColumnRenamed("_total", "raw_score")


def root_cause(df: DataFrame) -> Column:
    """First failing stage in order: model, extract, signals, summary, note, judge."""
    failed = F.lit(False)
    if "summary_mode" in df.columns:
        failed = (tx.text_or_empty(F.col("summary_error")) != "") & (F.col("summary_mode") != "model")
    return (
        F.when(failed, F.lit("summary_model"))
        .when(~F.col("extract_step.passed"), F.lit("extract"))
        .when(~F.col("signals_step.passed"), F.lit("signals"))
        .when(~F.col("summary_step.passed"), F.lit("summary"))
        .when(~F.col("note_step.passed"), F.lit("renderer"))
        .when(tx.text_or_empty(F.col("judge_root_cause")) != "", F.col("judge_root_cause"))
        .otherwise(F.lit("pass"))
    )


def fix_suggestion(cause: Column) -> Column:
    expr = F.lit(lx.FIX_SUGGESTIONS["pass"])
    for name, advice in lx.FIX_SUGGESTIONS.items():
        expr = F.when(cause == name, F.lit(advice)).otherwise(expr)
    return expr


def validated_judge(df: DataFrame) -> DataFrame:
    """Judge rows with a score in [0, 1] and a known root cause."""
    cause = tx.strip(tx.text_or_empty(F.col("root_cause")))
    return df.withColumns(
        {
            "judge_score": clamp01(F.coalesce(F.col("score").cast("double"), F.lit(0.0)) / 100.0),
            "judge_root_cause": F.when(cause.isin(*lx.JUDGE_ROOT_CAUSES), cause).otherwise(F.lit("pass")),
        }
    )


def compare_text(text: Column, required: Column, forbidden: Column, min_chars: Column) -> Column:
    """struct(score, recall, passed): recall minus forbidden hits minus a length penalty."""

    def body(key: Column) -> Column:
        missing = missing_items(key, required)
        hits = F.size(forbidden_hits(key, forbidden))
        size = F.length(tx.squash(tx.text_or_empty(text)))
        short = F.least(F.lit(0.35), (min_chars - size) / F.greatest(min_chars, F.lit(1)) * 0.35)
        rec = recall(required, missing)
        score = F.greatest(
            F.lit(0.0), rec - F.least(F.lit(0.4), 0.2 * hits) - F.when(size < min_chars, short).otherwise(F.lit(0.0))
        )
        return F.struct(
            F.round(score, 4).alias("score"),
            F.round(rec, 4).alias("recall"),
            ((score >= 0.78) & (F.size(missing) == 0) & (hits == 0)).alias("passed"),
        )

    return tx.let(tx.token(text), body)


def _shared_keys(text: Column, kinds: Column, gram: int) -> Column:
    """Distinct join keys a text offers: word n-grams and 1-2 characters, of the kinds that are asked for."""

    def words_of(xs: Column, size: int) -> Column:
        last = F.size(xs) - size + 1
        run = F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.concat(F.lit("w:"), F.array_join(F.slice(xs, i, size), " ")),
        )
        return F.when((last >= 1) & F.array_contains(kinds, f"w{size}"), run).otherwise(ar.empty_strings())

    def chars_of(cs: Column) -> Column:
        pairs = F.transform(cs, lambda c, i: F.concat(F.lit("c:"), c, F.coalesce(F.get(cs, i + 1), F.lit(""))))
        return F.concat(pairs, F.transform(cs, lambda c: F.concat(F.lit("c:"), c)))

    grams = tx.let(F.split(text, " "), lambda xs: F.concat(*[words_of(xs, size) for size in range(1, gram + 1)]))
    short = F.when(F.array_contains(kinds, "c"), tx.let(F.split(text, ""), chars_of)).otherwise(ar.empty_strings())
    return F.array_distinct(F.concat(grams, short))


def phrase_hits(
    docs: DataFrame, phrases: DataFrame, doc_id: str, text: str, phrase_id: str, phrase: str, gram: int = 3, max_keys: int = 1 << 16,
) -> DataFrame:
    """(phrase_id, doc_id) pairs where the normalised text contains the phrase.

    Inside a phrase every word but the first and last must be a whole word of the text, so
    those inner words (up to ``gram`` of them) are its key; phrases of one or two words have
    their first two characters. The distinct keys are counted and dealt into blocks of about
    ``max_keys``, each a subquery of one row of bounded size: a text keeps only those of its keys that are
    asked for, meets the phrases of these keys, and every candidate is verified in the row of its
    text. Each block reads the texts once, and they don't move as long as its phrases are small
    enough to be broadcast, which Spark decides by their size.
    """
    p = phrases.select(F.col(phrase_id), tx.token(F.col(phrase)).alias("_p")).filter("_p <> ''")
    p = p.withColumn("_n", F.size(F.split("_p", " ")))
    kind = F.when(F.col("_n") < 3, F.lit("c")).otherwise(
        F.concat(F.lit("w"), F.least(F.col("_n") - 2, F.lit(gram)).cast("string"))
    )
    key = F.when(F.col("_n") < 3, F.concat(F.lit("c:"), F.substring("_p", 1, 2))).otherwise(
        F.concat(F.lit("w:"), F.expr(f"array_join(slice(split(_p, ' '), 2, greatest(least(_n - 2, {gram}), 0)), ' ')"))
    )
    p = p.select(phrase_id, "_p", kind.alias("_kind"), key.alias("_key"))
    d = docs.select(F.col(doc_id), tx.token(F.col(text)).alias("_t"))

    def of_block(part: DataFrame) -> DataFrame:
        asked = part.agg(F.collect_set("_key")).scalar()
        kinds = part.agg(F.collect_set("_kind")).scalar()
        held = d.select(doc_id, "_t", asked.alias("_asked"), kinds.alias("_kinds"))
        shared = F.array_intersect(_shared_keys(F.col("_t"), F.col("_kinds"), gram), F.col("_asked"))
        held = held.select(doc_id, "_t", F.explode(shared).alias("_key"))
        return held.join(part.select("_key", phrase_id, "_p"), "_key").filter(F.contains("_t", "_p")).select(phrase_id, doc_id)

    blocks = max(1, -(-p.select("_key").distinct().count() // max_keys))
    if blocks == 1:
        return of_block(p)
    number = F.pmod(F.xxhash64("_key"), F.lit(blocks))
    found = [of_block(p.filter(number == i)) for i in range(blocks)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


# --- comparisons and iteration ---------------------------------------------------


def pick_winner(native: Column, skill: Column) -> Column:
    return F.when(native > skill, F.lit("native")).when(skill > native, F.lit("skill")).otherwise(F.lit("tie"))


def links_and_headings(doc: Column) -> Column:
    """struct(links, headings) of a document: media sources, then URLs inside sections."""
    found = F.flatten(
        F.transform(
            doc["sections"],
            lambda s: F.transform(
                F.regexp_extract_all(tx.text_or_empty(s["content"]), F.lit(r"https?://\S+"), 0),
                lambda u: tx.rstrip(u, ")]}>,.;"),
            ),
        )
    )
    media = F.concat(
        F.transform(doc["images"], lambda i: i["src"]), F.transform(doc["videos"], lambda v: v["src"])
    )
    headings = F.filter(F.transform(doc["sections"], lambda s: tx.text_or_empty(s["heading"])), lambda h: h != "")
    return F.struct(ar.keep_first(F.concat(media, found)).alias("links"), headings.alias("headings"))


def iterate_choice(baseline: DataFrame, searched: DataFrame) -> DataFrame:
    """Per case: baseline or searched candidate, score delta and what searching added.

    A searched candidate must be strictly better. Both sides hold one row per case
    with ``overall_score, root_cause, missing, warnings, links, headings``.
    """
    fields = ("overall_score", "root_cause", "missing", "warnings", "links", "headings")
    b = baseline.select("case_id", F.struct(*fields).alias("b"))
    s = searched.select("case_id", F.struct(*fields).alias("s"))
    better = F.col("s.overall_score") > F.col("b.overall_score")
    return b.join(s, "case_id").select(
        "case_id",
        F.when(better, F.lit("searched")).otherwise(F.lit("baseline")).alias("chosen"),
        F.round(F.col("s.overall_score") - F.col("b.overall_score"), 4).alias("score_delta"),
        ar.take(F.array_except("s.links", "b.links"), 5).alias("added_links"),
        ar.take(F.array_except("s.headings", "b.headings"), 5).alias("added_headings"),
        (F.size("s.warnings") - F.size("b.warnings")).alias("warning_delta"),
        ar.take(F.array_except("b.missing", "s.missing"), 6).alias("expectation_helped"),
        better.alias("search_helped"),
        F.col("b.root_cause").alias("case_problem_type"),
        fix_suggestion(F.col("b.root_cause")).alias("baseline_weakness"),
        F.when(better, F.col("s.root_cause")).otherwise(F.col("b.root_cause")).alias("chosen_root_cause"),
    )
