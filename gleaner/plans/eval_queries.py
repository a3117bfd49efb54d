"""Evaluation, roll-up and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import evaluation as ev
from gleaner.operators import reports as rp
from gleaner.plans import base, sql
from gleaner.plans.registry import query

# --- case results: one row per line item -------------------------------------------

_RESULTS = """results AS (
      SELECT l_orderkey % 7 + 1 AS round, l_returnflag AS model, CAST(l_partkey AS VARCHAR) AS case_id,
             CASE WHEN l_linestatus = 'O' THEN 'url' ELSE 'video_url' END AS source_kind, l_linenumber,
             l_quantity >= 20 AS passed, l_quantity / 64 AS overall_score, l_quantity / 1024 AS total_cost_usd,
             CASE WHEN l_quantity >= 20 THEN 'pass' WHEN l_quantity >= 15 THEN 'summary' WHEN l_quantity >= 8 THEN 'signals'
                  ELSE 'extract' END AS root_cause
      FROM lineitem)"""


def case_results(spark, sf_dir):
    df = base.read_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_partkey", "l_linestatus", "l_linenumber", "l_quantity"
    )
    q = F.col("l_quantity")
    cause = F.when(q >= 20, "pass").when(q >= 15, "summary").when(q >= 8, "signals").otherwise("extract")
    return df.select(
        (F.col("l_orderkey") % 7 + 1).alias("round"),
        F.col("l_returnflag").alias("model"),
        F.col("l_partkey").cast("string").alias("case_id"),
        F.when(F.col("l_linestatus") == "O", "url").otherwise("video_url").alias("source_kind"),
        "l_linenumber",
        (q >= 20).alias("passed"),
        (q / 64).alias("overall_score"),
        (q / 1024).alias("total_cost_usd"),
        cause.alias("root_cause"),
    )


@query(
    "eval_report",
    f"""WITH {_RESULTS} SELECT count(*) AS case_count, count(*) FILTER (WHERE passed) AS pass_count,
        round(sum(total_cost_usd), 6) AS total_cost_usd, round(count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate FROM results""",
)
def eval_report(spark, sf_dir):
    return rp.eval_report(case_results(spark, sf_dir))


@query("root_cause_counts", f"WITH {_RESULTS} SELECT root_cause, count(*) AS n_cases FROM results GROUP BY root_cause")
def root_cause_counts(spark, sf_dir):
    return rp.root_cause_counts(case_results(spark, sf_dir))


@query(
    "model_totals",
    f"""WITH {_RESULTS}, t AS (SELECT model, count(*) FILTER (WHERE passed) AS pass_count, count(*) AS total_count,
          round(sum(total_cost_usd), 6) AS total_cost_usd, count(DISTINCT round) AS rounds FROM results GROUP BY model)
        SELECT model, pass_count, total_count, round(pass_count / total_count, 4) AS pass_rate, total_cost_usd,
          round(total_cost_usd / rounds, 6) AS avg_cost_per_round_usd FROM t""",
)
def model_totals(spark, sf_dir):
    return rp.model_totals(case_results(spark, sf_dir))


@query(
    "stability_rollup",
    f"""WITH {_RESULTS} SELECT model, source_kind, count(*) FILTER (WHERE passed) AS pass_count, count(*) AS total_count,
          round(count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate FROM results GROUP BY ROLLUP (model, source_kind)""",
)
def stability_rollup(spark, sf_dir):
    return rp.source_kind_rollup(case_results(spark, sf_dir))


_STABLE = f"""{_RESULTS}, pc AS (SELECT case_id, model, root_cause, count(*) FILTER (WHERE passed) AS p, count(*) AS n
          FROM results GROUP BY ALL),
        st AS (SELECT case_id, model, CAST(sum(p) AS BIGINT) AS pass_count, CAST(sum(n) AS BIGINT) AS total_count,
          round(sum(p) / sum(n), 4) AS pass_rate, string_agg(root_cause || '=' || n, ',' ORDER BY root_cause) AS root_causes
          FROM pc GROUP BY case_id, model)"""


def _flat(df):
    entries = F.transform(
        F.sort_array(F.map_entries("root_causes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return df.withColumn("root_causes", F.array_join(entries, ","))


@query("case_stability", f"WITH {_STABLE} SELECT * FROM st")
def case_stability(spark, sf_dir):
    return _flat(rp.case_stability(case_results(spark, sf_dir)))


@query("unstable_cases", f"WITH {_STABLE} SELECT * FROM st WHERE pass_count < total_count ORDER BY model, pass_rate, case_id")
def unstable_cases(spark, sf_dir):
    return _flat(rp.unstable_cases(case_results(spark, sf_dir)))


@query(
    "stage_matrix",
    """WITH e AS (SELECT user_id, event_type, max(event_id) AS last_id FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY ALL),
        c AS (SELECT e.user_id, e.event_type, CASE WHEN v.value >= 10 THEN 'true' ELSE 'false' END || ' / ' || e.last_id || ' / ' || 'pass' AS cell
              FROM e JOIN events v ON v.event_id = e.last_id)
        SELECT user_id AS case_id, coalesce(max(cell) FILTER (WHERE event_type = 'click'), 'N/A') AS click,
          coalesce(max(cell) FILTER (WHERE event_type = 'view'), 'N/A') AS view,
          coalesce(max(cell) FILTER (WHERE event_type = 'signup'), 'N/A') AS signup FROM c GROUP BY user_id""",
)
def stage_matrix(spark, sf_dir):
    from gleaner.operators.keyed import distinct_last

    df = base.read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    df = df.filter(F.col("event_type").isin("click", "view", "signup")).withColumn("at", F.col("event_id"))
    latest = distinct_last(df, ["user_id", "event_type"], ["at"])
    stages = latest.select(
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("stage"),
        (F.col("value") >= 10).alias("passed"),
        F.col("event_id").alias("overall_score"),
        F.lit("pass").alias("root_cause"),
    )
    return rp.stage_matrix(stages, ["click", "view", "signup"])


@query(
    "run_plan",
    """SELECT d.doc_id AS case_id, m.model, r.round FROM documents d, (VALUES ('small'), ('large')) m(model), (VALUES (1), (2), (3)) r(round)""",
)
def run_plan(spark, sf_dir):
    cases = base.read_table(spark, sf_dir, "documents", F.col("doc_id").alias("case_id"))
    return rp.run_plan(cases, ["small", "large"], 3)


_PAIRS = """pairs AS (SELECT a.doc_id, a.n_chars % 101 / 128 AS native_score, length(a.text) % 37 / 64 AS skill_score,
          coalesce(l.quality, 0) = 1 AS native_passed, coalesce(l.toxic, 1) = 0 AS skill_passed
        FROM documents a LEFT JOIN labels l ON l.doc_id = a.doc_id),
      w AS (SELECT *, CASE WHEN native_score > skill_score THEN 'native' WHEN skill_score > native_score THEN 'skill' ELSE 'tie' END AS winner FROM pairs)"""


def pairs_table(spark, sf_dir):
    docs = base.read_table(spark, sf_dir, "documents", "doc_id", "n_chars", "text")
    labels = base.read_table(spark, sf_dir, "labels")
    df = docs.join(labels, "doc_id", "left").select(
        "doc_id",
        (F.col("n_chars") % 101 / 128).alias("native_score"),
        (F.length("text") % 37 / 64).alias("skill_score"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("native_passed"),
        (F.coalesce("toxic", F.lit(1)) == 0).alias("skill_passed"),
    )
    return df.withColumn("winner", ev.pick_winner(F.col("native_score"), F.col("skill_score")))


@query("pairwise_winner", f"WITH {_PAIRS} SELECT doc_id, winner FROM w")
def pairwise_winner(spark, sf_dir):
    return pairs_table(spark, sf_dir).select("doc_id", "winner")


@query(
    "side_by_side",
    f"""WITH {_PAIRS}, t AS (SELECT count(*) AS total_count,
          count(*) FILTER (WHERE native_passed) AS native_pass_count, round(avg(native_score), 4) AS native_avg_score, count(*) FILTER (WHERE winner = 'native') AS native_wins,
          count(*) FILTER (WHERE skill_passed) AS skill_pass_count, round(avg(skill_score), 4) AS skill_avg_score, count(*) FILTER (WHERE winner = 'skill') AS skill_wins,
          count(*) FILTER (WHERE winner = 'tie') AS ties FROM w)
        SELECT *, round(native_pass_count / total_count, 4) AS native_pass_rate, round(skill_pass_count / total_count, 4) AS skill_pass_rate FROM t""",
)
def side_by_side(spark, sf_dir):
    return rp.side_by_side(pairs_table(spark, sf_dir))


@query(
    "sample_outcomes",
    """SELECT user_id AS sample_id, bool_or(event_type = 'purchase' AND value >= 30) AS succeeded,
        count(*) FILTER (WHERE event_type = 'purchase' AND value >= 30) AS n_ok, count(*) AS n_attempts FROM events GROUP BY user_id""",
)
def sample_outcomes(spark, sf_dir):
    from gleaner.operators import predicates as pr

    df = base.read_table(spark, sf_dir, "events", "user_id", "event_type", "value")
    status = F.when(F.col("event_type") == "purchase", F.lit("done")).otherwise(F.lit("failed"))
    ok = pr.attempt_ok(status, F.col("value") >= 30, F.col("value") >= 0)
    return rp.sample_outcomes(df.select(F.col("user_id").alias("sample_id"), ok.alias("ok")))


@query(
    "report_lines",
    f"""WITH {_RESULTS} SELECT case_id, '| ' || case_id || ' | ' || CAST(passed AS VARCHAR) || ' | ' || CAST(CAST(overall_score * 64 AS BIGINT) AS VARCHAR) || ' | ' || root_cause || ' |' AS line FROM results""",
)
def report_lines(spark, sf_dir):
    df = case_results(spark, sf_dir)
    return rp.report_lines(df.withColumn("overall_score", (F.col("overall_score") * 64).cast("long")))


# --- cases: one document is one case --------------------------------------------------

_REQ = (("keyword", "the "), ("keyword", "en"), ("project", "licensed"), ("action", "de la"))
_FORBID = ("stupid", "trash", "555-")
_CASES = f"""{sql.lines()}, firsts AS (
        SELECT doc_id, arg_min(line, pos) AS title,
          coalesce(list(line ORDER BY pos) FILTER (WHERE length(line) BETWEEN 8 AND 120), []) AS good FROM lines GROUP BY doc_id),
      cases AS (SELECT d.doc_id, d.text, d.lang, coalesce(f.title, '') AS title, coalesce(f.good, [])[1:5] AS bullets, [d.lang, 'licensed'] AS sigs,
          d.lang = 'de' AS checklist, {sql.squash("d.text")} AS ev FROM documents d LEFT JOIN firsts f USING (doc_id)),
      keyed AS (SELECT *, lower(ev || ' ' || lang || ' licensed') AS ev_key, lower({sql.squash("title || chr(10) || array_to_string(bullets, chr(10))")}) AS sum_key,
          lower({sql.squash("title || chr(10) || text || chr(10) || repeat('x', 240)")}) AS note_key, title || chr(10) || text || chr(10) || repeat('x', 240) AS note FROM cases)"""


def _miss(key: str) -> str:
    return " + ".join(f"CAST(NOT contains({key}, {sql.lit(v.strip())}) AS INT)" for _, v in _REQ)


def _hits(key: str) -> str:
    return " + ".join(f"CAST(contains({key}, {sql.lit(v)}) AS INT)" for v in _FORBID)


_STEP_SQL = f"""{_CASES},
      m AS (SELECT *, {_miss("ev_key")} AS m_ev, {_miss("sum_key")} AS m_sum, {_miss("note_key")} AS m_note,
            {_hits("sum_key")} AS f_sum, {_hits("note_key")} AS f_note, length(ev) AS n_ev, length({sql.squash("note")}) AS n_note,
            (SELECT count(DISTINCT u) / count(u) FROM (SELECT trim(unnest(string_split(note, chr(10)))) AS u) WHERE u <> '') AS uniq FROM keyed),
      s AS (SELECT *, 0.35::DOUBLE * least(1.0::DOUBLE, n_ev / 397) + 0.65::DOUBLE * (1 - m_ev / 4) AS extract_score,
            1.0::DOUBLE AS signals_score,
            greatest(0, greatest(0, greatest(0, greatest(0, (1 - m_sum / 4) - least(0.5::DOUBLE, 0.2::DOUBLE * f_sum)) - CASE WHEN len(bullets) < 3 THEN 0.15::DOUBLE ELSE 0 END)
               - CASE WHEN length({sql.squash("title")}) < 12 THEN 0.15::DOUBLE ELSE 0 END) - CASE WHEN checklist AND len(bullets) < 2 THEN 0.2::DOUBLE ELSE 0 END) AS summary_score,
            greatest(0, 0.55::DOUBLE * (1 - m_note / 4) + 0.30::DOUBLE * least(1.0::DOUBLE, n_note / 240) + 0.15::DOUBLE * coalesce(uniq, 0)
               - CASE WHEN coalesce(uniq, 0) < 0.72 THEN least(0.35::DOUBLE, (0.72::DOUBLE - coalesce(uniq, 0)) * 0.8::DOUBLE) ELSE 0 END - least(0.4::DOUBLE, 0.2::DOUBLE * f_note)) AS note_score FROM m),
      p AS (SELECT *, extract_score >= 0.75 AND m_ev = 0 AS extract_ok, true AS signals_ok, summary_score >= 0.75 AND m_sum = 0 AND f_sum = 0 AS summary_ok,
            note_score >= 0.7 AND m_note + CAST(checklist AS INT) = 0 AND f_note = 0 AS note_ok FROM s)"""


def scored_cases(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text", "lang")
    df = df.withColumn("xs", ar.lines(F.col("text")))
    title = F.coalesce(F.try_element_at("xs", F.lit(1)), F.lit(""))
    bullets = ar.take(F.filter("xs", lambda x: F.length(x).between(8, 120)), 5)
    required = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in _REQ])
    df = df.select(
        "doc_id",
        "lang",
        required.alias("required"),
        ar.strings(*_FORBID).alias("forbidden"),
        F.lit(397).alias("min_evidence_chars"),
        (F.col("lang") == "de").alias("require_action_checklist"),
        F.col("text").alias("evidence_text"),
        F.array("lang", F.lit("licensed")).alias("signal_values"),
        title.alias("title"),
        title.alias("conclusion"),
        bullets.alias("bullets"),
        ar.empty_strings().alias("quotes"),
        bullets.alias("actions"),
        F.concat(title, F.lit("\n"), F.col("text"), F.lit("\n" + "x" * 240)).alias("note"),
    )
    return ev.score_steps(df)


@query(
    "step_scores",
    f"""WITH {_STEP_SQL} SELECT doc_id, round(extract_score + 0.0000001::DOUBLE, 4) AS extract_score, extract_ok, round(signals_score + 0.0000001::DOUBLE, 4) AS signals_score,
        round(summary_score + 0.0000001::DOUBLE, 4) AS summary_score, summary_ok, round(note_score + 0.0000001::DOUBLE, 4) AS note_score, note_ok FROM p""",
)
def step_scores(spark, sf_dir):
    df = scored_cases(spark, sf_dir)
    return df.select(
        "doc_id",
        F.round(F.col("extract_step.score") + 1e-7, 4).alias("extract_score"),
        F.col("extract_step.passed").alias("extract_ok"),
        F.round(F.col("signals_step.score") + 1e-7, 4).alias("signals_score"),
        F.round(F.col("summary_step.score") + 1e-7, 4).alias("summary_score"),
        F.col("summary_step.passed").alias("summary_ok"),
        F.round(F.col("note_step.score") + 1e-7, 4).alias("note_score"),
        F.col("note_step.passed").alias("note_ok"),
    )


_OVERALL = f"""{_STEP_SQL}, o AS (SELECT *, extract_score * 0.35::DOUBLE + signals_score * 0.20::DOUBLE + summary_score * 0.30::DOUBLE + note_score * 0.15::DOUBLE AS base FROM p)"""


@query(
    "overall_scores",
    f"""WITH {_OVERALL}, j AS (SELECT o.*, l.quality FROM o LEFT JOIN labels l USING (doc_id)),
        t AS (SELECT *, CASE WHEN quality IS NOT NULL THEN base * 0.75::DOUBLE + quality * 0.25::DOUBLE ELSE base END AS total FROM j)
        SELECT doc_id, round(total + 0.0000001::DOUBLE, 4) AS overall_score,
          total >= 0.78 AND m_ev + m_sum + m_note + CAST(checklist AS INT) = 0 AND f_sum + f_note = 0 AND (quality IS NULL OR quality >= 0.72) AS passed,
          CASE WHEN NOT extract_ok THEN 'extract' WHEN NOT summary_ok THEN 'summary' WHEN NOT note_ok THEN 'renderer'
               WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'summary' ELSE 'pass' END AS root_cause FROM t""",
)
def overall_scores(spark, sf_dir):
    labels = base.read_table(spark, sf_dir, "labels", "doc_id", "quality")
    judge = ev.validated_judge(
        labels.select(
            "doc_id",
            (F.col("quality") * 100).alias("score"),
            F.when(F.col("quality") == 1, F.lit("pass")).otherwise(F.lit("summary")).alias("root_cause"),
        )
    ).drop("score", "root_cause")
    df = scored_cases(spark, sf_dir).join(judge, "doc_id", "left")
    return ev.overall(df).select("doc_id", F.round(F.col("raw_score") + 1e-7, 4).alias("overall_score"), "passed", "root_cause")


@query(
    "iterative_scores",
    f"""WITH {_OVERALL}, t AS (SELECT *, greatest(0, base - least(0.25::DOUBLE, 0.05::DOUBLE * (doc_id % 4))) AS total FROM o)
        SELECT doc_id, round(total + 0.0000001::DOUBLE, 4) AS overall_score, total >= 0.72 AND f_sum + f_note = 0 AS passed FROM t""",
)
def iterative_scores(spark, sf_dir):
    df = scored_cases(spark, sf_dir).withColumn("warning_count", F.col("doc_id") % 4)
    return ev.overall(df, iterative=True).select("doc_id", F.round(F.col("raw_score") + 1e-7, 4).alias("overall_score"), "passed")


@query(
    "expectation_recall",
    f"""WITH {_STEP_SQL} SELECT doc_id, round(1 - m_note / 4, 4) AS recall, CAST(m_note AS INT) AS n_missing, f_note AS n_forbidden FROM p""",
)
def expectation_recall(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text")
    required = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in _REQ])
    first = F.coalesce(F.try_element_at(ar.lines(F.col("text")), F.lit(1)), F.lit(""))
    df = df.select("doc_id", tx.token(F.concat(first, F.lit("\n"), "text")).alias("key"), required.alias("required"))
    df = df.withColumn("missing", ev.missing_items(F.col("key"), F.col("required")))
    return df.select(
        "doc_id",
        F.round(ev.recall(F.col("required"), F.col("missing")), 4).alias("recall"),
        F.size("missing").alias("n_missing"),
        F.size(ev.forbidden_hits(F.col("key"), ar.strings(*_FORBID))).alias("n_forbidden"),
    )


@query(
    "text_comparison",
    f"""WITH t AS (SELECT doc_id, lower({sql.squash("text")}) AS key, length({sql.squash("text")}) AS n FROM documents),
        x AS (SELECT doc_id, 1 - ({_miss("key")}) / 4 AS rec, {_hits("key")} AS hits, n FROM t),
        s AS (SELECT *, greatest(0, rec - least(0.4::DOUBLE, 0.2::DOUBLE * hits) - CASE WHEN n < 500 THEN least(0.35::DOUBLE, (500 - n) / 500 * 0.35::DOUBLE) ELSE 0 END) AS score FROM x)
        SELECT doc_id, round(score, 4) AS score, round(rec, 4) AS recall, score >= 0.78 AND rec = 1 AND hits = 0 AS passed FROM s""",
)
def text_comparison(spark, sf_dir):
    df = base.documents(spark, sf_dir, "doc_id", "text")
    required = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("value")) for a, b in _REQ])
    return df.select(
        "doc_id", ev.compare_text(F.col("text"), required, ar.strings(*_FORBID), F.lit(500)).alias("c")
    ).select("doc_id", "c.*")


@query(
    "phrase_contains",
    f"""SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower({sql.squash("d.text")}), lower({sql.squash("b.text")}))""",
)
def phrase_contains(spark, sf_dir):
    docs = base.documents(spark, sf_dir, "doc_id", "text")
    items = base.read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return ev.phrase_hits(docs, items, "doc_id", "text", "item_id", "phrase")


@query(
    "iterate_choice",
    """WITH b AS (SELECT doc_id, n_chars % 11 / 16 AS s, CASE WHEN lang = 'de' THEN 'extract' ELSE 'pass' END AS rc FROM documents),
        q AS (SELECT doc_id, quality / 2 AS s FROM labels)
        SELECT b.doc_id AS case_id, CASE WHEN q.s > b.s THEN 'searched' ELSE 'baseline' END AS chosen, round(q.s - b.s, 4) AS score_delta,
          b.rc AS case_problem_type, CASE WHEN q.s > b.s THEN 'pass' ELSE b.rc END AS chosen_root_cause, 'm1' AS expectation_helped
        FROM b JOIN q USING (doc_id)""",
)
def iterate_choice(spark, sf_dir):
    docs = base.read_table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang")
    none = ar.empty_strings()
    baseline = docs.select(
        F.col("doc_id").alias("case_id"), (F.col("n_chars") % 11 / 16).alias("overall_score"),
        F.when(F.col("lang") == "de", "extract").otherwise("pass").alias("root_cause"),
        ar.strings("m1", "m2").alias("missing"), none.alias("warnings"), none.alias("links"), none.alias("headings"),
    )
    labels = base.read_table(spark, sf_dir, "labels", "doc_id", "quality")
    searched = labels.select(
        F.col("doc_id").alias("case_id"), (F.col("quality") / 2).alias("overall_score"), F.lit("pass").alias("root_cause"),
        ar.strings("m2").alias("missing"), none.alias("warnings"), none.alias("links"), none.alias("headings"),
    )
    out = ev.iterate_choice(baseline, searched)
    return out.select(
        "case_id", "chosen", "score_delta", "case_problem_type", "chosen_root_cause",
        F.array_join("expectation_helped", ",").alias("expectation_helped"),
    )
