"""Report forms as ordered rows, changes by a search, and documents as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.operators import evaluation as ev
from gleaner.operators import evidence, pages, summaries
from gleaner.operators import reports as rp
from gleaner.plans import base, sql
from gleaner.plans.eval_queries import _RESULTS, case_results
from gleaner.plans.evidence_queries import _DOC, _SIG, structured
from gleaner.plans.registry import query


def _head(section: int, *lines: str) -> str:
    return " UNION ALL ".join(f"SELECT {section}, NULL, {i}, {sql.lit(line)}" for i, line in enumerate(lines))


@query(
    "stability_report",
    f"""WITH {_RESULTS}, m AS (SELECT model, count(*) FILTER (WHERE passed) AS p, count(*) AS n, round(sum(total_cost_usd), 6) AS cost, count(DISTINCT round) AS rounds FROM results GROUP BY model),
        k AS (SELECT model, source_kind, count(*) FILTER (WHERE passed) AS p, count(*) AS n FROM results GROUP BY ALL),
        c AS (SELECT case_id, model, count(*) FILTER (WHERE passed) AS p, count(*) AS n FROM results GROUP BY ALL),
        s AS (SELECT case_id, model, p, n, CAST(round(p / n, 4) AS VARCHAR) AS rate FROM c),
        x AS (SELECT case_id, min(source_kind) AS kind FROM results GROUP BY case_id),
        g AS (SELECT case_id, {", ".join(f"coalesce(max(p || '/' || n || ' (' || rate || ')') FILTER (WHERE model = '{v}'), '0/0 (0.0)') AS {v}" for v in "ANR")} FROM s GROUP BY case_id),
        h AS (SELECT case_id, model, string_agg(root_cause || ':' || n, ', ' ORDER BY root_cause) AS causes FROM (SELECT case_id, model, root_cause, count(*) AS n FROM results GROUP BY ALL) GROUP BY ALL),
        r(section, key, part, line) AS ({_head(1, "# Stability Validation Report", "- rounds: 7", "## Model Overview", "| model | pass | total | pass_rate | total_cost_usd | avg_cost_per_round |")}
          UNION ALL SELECT 1, model, 0, '| ' || concat_ws(' | ', model, p, n, round(p / n, 4), cost, round(cost / rounds, 6)) || ' |' FROM m
          UNION ALL {_head(2, "## Source Type Stability", "| model | source_kind | pass | total | pass_rate |")}
          UNION ALL SELECT 2, model || chr(1) || source_kind, 0, '| ' || concat_ws(' | ', model, source_kind, p, n, round(p / n, 4)) || ' |' FROM k
          UNION ALL {_head(3, "## Case Stability", "| case_id | source_kind | A pass/total(rate) | N pass/total(rate) | R pass/total(rate) |")}
          UNION ALL SELECT 3, case_id, 0, '| ' || concat_ws(' | ', case_id, kind, A, N, R) || ' |' FROM g JOIN x USING (case_id)
          UNION ALL {_head(4, "## Unstable Cases")}
          UNION ALL SELECT 4, model || chr(1) || rate || chr(1) || case_id, 0, '- case=' || case_id || ' model=' || model || ' pass=' || p || '/' || n || ' rate=' || rate || ' root_causes=' || causes
            FROM s JOIN h USING (case_id, model) WHERE p < n) SELECT * FROM r""",
)
def stability_report(spark, sf_dir):
    return rp.stability_report(case_results(spark, sf_dir), ["A", "N", "R"], 7)


_STAGES = ("view", "click", "error")


def stage_results(spark, sf_dir):
    e = base.read_table(spark, sf_dir, "events", "user_id", "event_type", "value").where(F.col("event_type").isin(*_STAGES))
    best = e.groupBy(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("stage")).agg(F.max("value").alias("overall_score"))
    passed = F.col("overall_score") > 60
    return best.withColumns({
        "passed": passed, "root_cause": F.when(passed, "pass").otherwise("signals"),
        "missing": F.when(passed, ar.empty_strings()).otherwise(F.array(F.lit("links"), F.col("stage"))),
    })


@query(
    "progressive_report",
    f"""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS stage, max(value) AS score, list_position(['view', 'click', 'error'], event_type) AS pos FROM events
          WHERE event_type IN ('view', 'click', 'error') GROUP BY ALL),
        c AS (SELECT *, score > 60 AS ok, CASE WHEN score > 60 THEN 'pass' ELSE 'signals' END AS rc FROM b),
        t AS (SELECT stage, pos, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM c GROUP BY ALL),
        g AS (SELECT case_id, {", ".join(f"coalesce(max(ok || ' / ' || score || ' / ' || rc) FILTER (WHERE stage = '{s}'), 'N/A') AS s{i}" for i, s in enumerate(_STAGES))} FROM c GROUP BY case_id),
        r(section, key, part, line) AS ({_head(1, "# Progressive Validation Report", "## Stage Summary", "| stage | case_count | pass_count | pass_rate |")}
          UNION ALL SELECT 1, CAST(pos AS VARCHAR), 0, '| ' || concat_ws(' | ', stage, n, k, round(k / n, 4)) || ' |' FROM t
          UNION ALL {_head(2, "## Case Matrix", "| case_id | view (pass/score/root) | click (pass/score/root) | error (pass/score/root) |")}
          UNION ALL SELECT 2, case_id, 0, '| ' || concat_ws(' | ', case_id, s0, s1, s2) || ' |' FROM g
          UNION ALL {_head(3, "## Failing Cases")}
          UNION ALL SELECT 3, pos || chr(1) || case_id, 0, stage || ' - ' || case_id || ': ' || rc || ' | missing=links, ' || stage FROM c WHERE NOT ok) SELECT * FROM r""",
)
def progressive_report(spark, sf_dir):
    return rp.progressive_report(stage_results(spark, sf_dir), _STAGES)


@query(
    "truth_report",
    f"""WITH c AS (SELECT user_id, event_type, count(*) AS n, max(value) AS hi, min(value) AS lo FROM events GROUP BY ALL),
        r(section, key, part, line) AS ({_head(1, "# Video Truth Validation Report", "## Summary", "| case_id | model | passed | outline_detected | story_blocks | workflow | risk | feedback | bullet_quality | root_cause |")}
          UNION ALL SELECT 1, user_id || chr(1) || event_type, 0, '| ' || concat_ws(' | ', user_id, event_type, hi > 60 AND lo < 5, n > 3, n, hi > 60, lo < 5, n > 10, hi > 80,
            CASE WHEN hi > 60 AND lo < 5 THEN 'pass' ELSE 'summary' END) || ' |' FROM c) SELECT * FROM r""",
)
def truth_report(spark, sf_dir):
    e = base.read_table(spark, sf_dir, "events", "user_id", "event_type", "value")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    passed = (F.col("hi") > 60) & (F.col("lo") < 5)
    return rp.truth_report(c.select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("model"), passed.alias("passed"), (F.col("n") > 3).alias("outline_detected"), F.col("n").alias("story_block_count"),
        (F.col("hi") > 60).alias("workflow_hit"), (F.col("lo") < 5).alias("risk_hit"), (F.col("n") > 10).alias("viewer_feedback_hit"), (F.col("hi") > 80).alias("bullet_quality_ok"),
        F.when(passed, "pass").otherwise("summary").alias("root_cause"),
    ))


_CHOICES = """c AS (SELECT CAST(d.doc_id AS VARCHAR) AS case_id, n_chars % 11 / 16 AS b, quality / 2 AS s, lang = 'de' AS bad, source, lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
      x AS (SELECT *, CASE WHEN s > b THEN 'searched' ELSE 'baseline' END AS chosen, CASE WHEN bad THEN 'extract' ELSE 'pass' END AS rc FROM c)"""


def sides(spark, sf_dir):
    """A baseline and a searched run of the labelled documents that differ in links, headings and warnings."""
    d = base.read_table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang", "source").join(base.read_table(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    key, gap = F.col("doc_id").cast("string").alias("case_id"), ar.strings("m1", "m2")
    cause = F.when(F.col("lang") == "de", "extract").otherwise("pass")
    baseline = d.select(key, (F.col("n_chars") % 11 / 16).alias("overall_score"), cause.alias("root_cause"), gap.alias("missing"), ar.strings("w").alias("warnings"),
                        F.array("source").alias("links"), F.array("lang", "source").alias("headings"))
    searched = d.select(key, (F.col("quality") / 2).alias("overall_score"), F.lit("pass").alias("root_cause"), ar.strings("m2").alias("missing"), ar.empty_strings().alias("warnings"),
                        F.array("lang", "source").alias("links"), F.array(F.col("source"), F.concat(F.lit("h-"), "lang")).alias("headings"))
    return baseline, searched


@query(
    "iterate_delta",
    f"""WITH {_CHOICES} SELECT case_id, chosen, lang AS added_links, 'h-' || lang AS added_headings, -1 AS warning_delta, 'm1' AS expectation_helped FROM x""",
)
def iterate_delta(spark, sf_dir):
    """What a search added to every case."""
    out = ev.iterate_choice(*sides(spark, sf_dir))
    return out.select("case_id", "chosen", *[F.array_join(c, ",").alias(c) for c in ("added_links", "added_headings", "expectation_helped")], "warning_delta")


@query(
    "iterative_report",
    f"""WITH {_CHOICES}, f(part, name) AS (VALUES (1, 'chosen'), (2, 'baseline_score'), (3, 'searched_score'), (4, 'baseline_root_cause'), (5, 'searched_root_cause'), (6, 'search_helped'), (7, 'added_links'), (8, 'added_headings')),
        r(section, key, part, line) AS ({_head(1, "# Iterative Recognition Report", "## Case Overview", "| case_id | baseline_score | searched_score | chosen | diagnosis |")}
          UNION ALL SELECT 1, case_id, 0, '| ' || concat_ws(' | ', case_id, b, s, chosen, rc) || ' |' FROM x
          UNION ALL {_head(2, "## Root Cause Stats")}
          UNION ALL SELECT 2, rc, 0, '- ' || rc || ': ' || count(*) FROM x GROUP BY rc
          UNION ALL {_head(3, "## Details")}
          UNION ALL SELECT 3, case_id, 0, '### ' || case_id FROM x
          UNION ALL SELECT 3, case_id, part, '- ' || name || ': ' || list_extract([chosen, CAST(b AS VARCHAR), CAST(s AS VARCHAR), rc, 'pass', CAST(chosen = 'searched' AS VARCHAR), lang, 'h-' || lang], part) FROM x, f) SELECT * FROM r""",
)
def iterative_report(spark, sf_dir):
    baseline, searched = sides(spark, sf_dir)
    scores = [df.select("case_id", F.col("overall_score").alias(f"{n}_score"), F.col("root_cause").alias(f"{n}_root_cause")) for n, df in (("baseline", baseline), ("searched", searched))]
    choices = ev.iterate_choice(baseline, searched).select("case_id", "chosen", "case_problem_type", "added_links", "added_headings")
    return rp.iterative_report(choices.join(scores[0], "case_id").join(scores[1], "case_id"))


_DOC_TEXT = f"""WITH {_DOC}, b AS (SELECT page_id, string_agg(heading || ': ' || trim(content), chr(10) ORDER BY g) AS body FROM
          (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY g) AS n FROM secs WHERE g > 0 AND content IS NOT NULL) WHERE n <= 6 GROUP BY page_id),
        e AS (SELECT x.page_id, title, ({sql.clip("x.body", 220)}) AS summary, '标题: ' || title || chr(10) || '摘要: ' || ({sql.clip("x.body", 220)}) || chr(10) || '[章节]' || chr(10) || b.body AS text, p.url
          FROM x JOIN b USING (page_id) JOIN pages p USING (page_id))"""


@query(
    "document_evidence",
    rf"""{_DOC_TEXT} SELECT page_id, text || CASE WHEN starts_with(url, 'https') THEN chr(10) || chr(10) || '[搜索补充]' || chr(10) || 'see ' || url ELSE '' END AS text,
        'structured_document' AS evidence_type, 'full' AS coverage, CASE WHEN starts_with(url, 'https') THEN '' ELSE 'plain' END AS fetch_warnings FROM e""",
)
def document_evidence(spark, sf_dir):
    """Structured pages as evidence, with search text behind those of secure pages and a warning on the others."""
    df = structured(spark, sf_dir).select("page_id", F.col("url").alias("source_url"), pages.extractive_document(F.col("doc")).alias("document"))
    secure = F.startswith("source_url", F.lit("https"))
    df = df.withColumns({"extra": F.when(secure, F.concat(F.lit("  see "), "source_url")), "warnings": F.when(~secure, ar.strings("plain"))})
    out = evidence.document_evidence(df, extra="extra", lexicon=_SIG)
    return out.select("page_id", "text", "evidence_type", "coverage", F.array_join("fetch_warnings", ",").alias("fetch_warnings"))


@query(
    "extended_document",
    rf"""{_DOC_TEXT}, n AS (SELECT page_id, count(*) AS n FROM secs WHERE g > 0 AND content IS NOT NULL GROUP BY page_id)
        SELECT page_id, CASE WHEN starts_with(url, 'https') THEN substr(trim(summary || ' see ' || url), 1, 400) ELSE summary END AS summary,
        n + starts_with(url, 'https')::BIGINT AS n_sections, CASE WHEN starts_with(url, 'https') THEN 'see ' || url END AS added FROM e JOIN n USING (page_id)""",
)
def extended_document(spark, sf_dir):
    """Documents with a section of search text."""
    df = structured(spark, sf_dir).select("page_id", "url", pages.extractive_document(F.col("doc")).alias("document"))
    secure = F.startswith("url", F.lit("https"))
    df = df.withColumn("more", summaries.extend_document(F.col("document"), F.when(secure, F.concat(F.lit("see "), "url"))))
    last = F.element_at("more.sections", -1)
    return df.select("page_id", "more.summary", F.size("more.sections").cast("long").alias("n_sections"), F.when(last["heading"] == "Search Enrichment", last["content"]).alias("added"))
