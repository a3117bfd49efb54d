"""Composite jobs and ties that the rules decide on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.config import CacheConfig, RoutingConfig
from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.operators import cost, evaluation, evidence, media, notes, pages, quality, reports, summaries

REQUEST = (
    "doc_id bigint, source_kind string, source_url string, raw_text string, platform_hint string, page_title string, page_text string, "
    "repo_lines array<string>, ocr_lines array<string>, fetch_warnings array<string>"
)


def build(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUEST)
    return {r["doc_id"]: r for r in evidence.build_evidence(df).collect()}


def test_evidence_branches(spark):
    footer = "沪ICP备 营业执照 增值电信业务经营许可证"
    xhs = "https://www.xiaohongshu.com/explore/a"
    out = build(
        spark,
        ("pasted_text", None, "  hello  ", None, None, None, None, None, None),
        ("url", "https://e.com", "https://e.com", None, "T", "page body", None, None, None),
        ("mixed", "https://e.com", "note", None, "T", "page body", None, ["https://github.com/a/b"], None),
        ("url", "https://e.com", "", None, None, "", None, None, ["fetch_failed: x", "fetch_failed: x", "second"]),
        ("url", xhs, "", None, "页面不见了", footer, None, None, None),
        ("url", "https://github.com/a/b", "mine", None, "a/b", "html", ["项目仓库: a/b", "仓库地址: https://github.com/a/b"], None, None),
        ("image", None, "caption", None, None, None, None, ["技能ID: some-skill-id", "x"], None),
        ("video_url", "https://v.com", "x", None, None, None, None, None, None),
    )
    assert 7 not in out
    assert (out[0]["text"], out[0]["evidence_type"], out[0]["coverage"]) == ("hello", "raw_text", "full")
    assert out[1]["text"] == "page body" and out[1]["evidence_sources"] == ["web_html_document"]
    assert out[2]["text"] == "note\n\npage body\n\n[OCR补充]\nhttps://github.com/a/b"
    assert out[2]["signals"]["projects"] == ["a/b"]
    assert out[3]["text"] == "[fetch error] fetch_failed: x | second"
    assert out[4]["text"].startswith("这条小红书图文") and out[4]["coverage"] == "partial"
    assert out[4]["evidence_sources"] == ["web_html_document", "web_blocked_notice"]
    assert out[5]["branch"] == "repository" and out[5]["text"].endswith("\n\nmine")
    assert out[5]["signals"]["projects"] == ["a/b"] and out[5]["profile"] == "project_overview"
    assert out[5]["requirements"]["required_values"][0].asDict() == {"key": "projects", "value": "a/b"}
    assert out[6]["text"] == "技能ID: some-skill-id\nx\n\ncaption" and out[6]["evidence_type"] == "ocr"


def media_rows(spark, spoken, ocr):
    track = "struct<text:string,language:string,duration_seconds:double,timeline:array<string>>"
    schema = (
        f"source_url string, raw_text string, metadata_text string, subtitle {track}, transcript {track}, keyframes array<string>, "
        "keyframe_text array<string>, ocr_lines array<string>"
    )
    row = ("https://www.bilibili.com/video/BV1HpP5zBEEp", "重点看部署", "[视频元数据]\n标题: t", ("字幕第一行 00:30", "zh", None, ["[00:01] 安装部署教程，第一步"]),
           (spoken, "zh", 95.5, []), ["k.png"], ["帧文字"], ocr)
    return media.merge_media_evidence(spark.createDataFrame([row], schema)).first()


def test_media_merge(spark):
    short = media_rows(spark, "短", ["普通画面文字内容"])
    assert "[关键帧OCR]\n普通画面文字内容" in short["text"] and short["user_guidance"] == "重点看部署"
    assert short["duration_seconds"] == 95.5 and short["tracks"]["has_keyframe_ocr"] and short["tracks"]["has_subtitle"]
    assert short["text"].endswith("[视频时间线要点]\n[00:01] 安装部署教程，第一步")
    assert short["signals"]["links"] == ["https://www.bilibili.com/video/BV1HpP5zBEEp"] and short["profile"] == "video_explainer"
    long_speech = "这是一段足够长的语音内容。" * 20
    assert "关键帧OCR" not in media_rows(spark, long_speech, ["普通画面文字内容"])["text"]
    assert "github.com/a/b" in media_rows(spark, long_speech, ["https://github.com/a/b"])["text"]


def test_upgrade_wins_a_tie_and_needs_a_reason(spark):
    p = spark.createDataFrame([(1, 0.6, 1.0), (2, 0.9, 1.0), (3, 0.8, 0.5), (4, 0.5, 1.0)], "k bigint, score double, coverage double")
    u = spark.createDataFrame([(1, 0.6), (2, 1.0), (3, 0.7)], "k bigint, score double")
    out = {r["k"]: r["chosen"] for r in quality.choose_summary(p, u, "k", RoutingConfig()).collect()}
    assert out == {1: "upgrade", 2: "primary", 3: "primary", 4: "primary"}


def test_baseline_wins_a_tie(spark):
    schema = "case_id string, overall_score double, root_cause string, missing array<string>, warnings array<string>, links array<string>, headings array<string>"
    base = spark.createDataFrame([("a", 0.5, "extract", ["m", "n"], [], ["l"], []), ("b", 0.5, "extract", [], [], [], [])], schema)
    found = spark.createDataFrame([("a", 0.6, "pass", ["n"], ["w"], ["l", "new"], ["h"]), ("b", 0.5, "pass", [], [], [], [])], schema)
    out = {r["case_id"]: r for r in evaluation.iterate_choice(base, found).collect()}
    assert out["b"]["chosen"] == "baseline" and out["a"]["chosen"] == "searched"
    assert out["a"]["added_links"] == ["new"] and out["a"]["expectation_helped"] == ["m"] and out["a"]["score_delta"] == 0.1


def test_cache_entry_at_exactly_the_ttl_is_valid(spark):
    items = spark.createDataFrame([(1, "https://E.com/x?utm_a=1", "fp"), (2, "https://e.com/y", "fp"), (3, "https://e.com/x", "other"), (4, "", "fp")],
                                  "i bigint, source_url string, fingerprint string")
    cache = spark.createDataFrame([("https://e.com/x", "2026-01-01 00:00:00", "fp", "s"), ("https://e.com/y", "2025-12-31 23:59:59", "fp", "s")],
                                  "source_url string, created_at string, fingerprint string, summary string")
    cache = cache.withColumn("created_at", F.to_timestamp("created_at"))
    now = F.lit("2026-01-04 00:00:00").cast("timestamp")
    out = {r["i"]: r["cached"] for r in evidence.cache_lookup(items, cache, now, CacheConfig()).collect()}
    assert out == {1: True, 2: False, 3: False, 4: False}


def test_unstable_cases_order(spark):
    rows = [("b", "m1", True), ("b", "m1", False), ("a", "m1", False), ("a", "m1", True), ("c", "m1", False), ("z", "m0", False), ("ok", "m0", True)]
    df = spark.createDataFrame(rows, "case_id string, model string, passed boolean").withColumn("root_cause", F.when(F.col("passed"), "pass").otherwise("extract"))
    out = [(r["model"], r["case_id"], r["pass_rate"], r["root_causes"]) for r in reports.unstable_cases(df).collect()]
    assert [o[:3] for o in out] == [("m0", "z", 0.0), ("m1", "c", 0.0), ("m1", "a", 0.5), ("m1", "b", 0.5)]
    assert out[2][3] == {"extract": 1, "pass": 1}


def test_text_to_summary_and_extension(spark):
    base = F.struct(F.lit("base").alias("title"), F.lit("c").alias("conclusion"), ar.strings("b").alias("bullets"), ar.strings("q").alias("quotes"))
    df = spark.createDataFrame([("- First line.\n12s · $0.1 · 9 words\n* first line.\nsee https://e.com now\nabc",), ("",)], "t string")
    a, b = [r["s"] for r in df.select(summaries.summary_from_text(F.col("t"), base).alias("s")).collect()]
    assert a["title"] == "First line." and a["bullets"] == ["First line.", "see https://e.com now"] and a["quotes"] == ["see https://e.com now"]
    assert (b["title"], b["bullets"], b["quotes"]) == ("base", ["b"], ["q"])
    page = spark.createDataFrame([(1, "https://e.com", "<title>T</title><article><h1>H</h1><p>body text</p></article>")], "page_id bigint, url string, html string")
    doc = pages.structure_pages(page).select(pages.extractive_document(F.col("doc")).alias("d"))
    out = doc.select(summaries.extend_document(F.col("d"), F.lit(" found ")).alias("e"), summaries.extend_document(F.col("d"), F.lit("")).alias("n")).first()
    assert out["e"]["summary"] == "body text found" and out["e"]["sections"][-1]["heading"] == "Search Enrichment"
    assert out["n"]["summary"] == "body text" and len(out["n"]["sections"]) == 1


def test_digest_fields(spark):
    bullets = ["1. 内容一。", "项目名称: a/b", "GitHub地址: https://github.com/a/b", "内容二", "内容三", "内容四"]
    df = spark.createDataFrame([(bullets, "第一句。第二句")], "b array<string>, c string")
    out = df.select(summaries.digest_fields(F.col("b"), F.col("c")).alias("d")).first()["d"]
    assert out["content"] == ["内容一", "项目名称: a/b", "内容二"] and out["links"] == ["https://github.com/a/b"]
    assert (out["project"], out["repo_url"], out["lead"], out["compact"]) == ("a/b", "https://github.com/a/b", "第一句", False)


def test_rule_summary_uses_signals_and_steps(spark):
    df = spark.createDataFrame([(1, "GitHub - a/b", "https://github.com/a/b", "项目介绍第一行内容\nnpm install -g b\n短", "partial")],
                               "doc_id bigint, title string, source_url string, text string, coverage string")
    from gleaner.operators import signals

    df = signals.extract_signals(df).withColumn("step_items", F.array().cast("array<struct<title:string,detail:string,command:string>>"))
    out = summaries.rule_summary(df).first()
    assert out["summary_title"] == "a/b" and out["bullets"] == ["命令: npm install -g b", "项目介绍第一行内容", "npm install -g b"]
    assert out["conclusion"] == "包含可执行命令，证据不完整。" and out["quotes"] == ["项目介绍第一行内容", "npm install -g b"]


def test_vault_rebuild(spark):
    rows = [("Inbox/a.md", "T", "https://e.com", "x", ["AI", "Old"]), ("Inbox/b.md", "T", "https://e.com", "x", ["AI"]), ("Inbox/c.md", "U", "", "", ["Keep"])]
    table = spark.createDataFrame(rows, "path string, title string, source_url string, raw_evidence string, topic_names array<string>")
    index = spark.createDataFrame([("AI", "Inbox/a.md"), ("Old", "Inbox/a.md"), ("Keep", "Else/z.md")], "topic string, note string")
    vault = notes.rebuild_vault(table, index, "Inbox")
    assert sorted(r["path"] for r in vault.notes.collect()) == ["Inbox/b.md", "Inbox/c.md"]
    assert sorted((r["topic"], r["note"]) for r in vault.index.collect()) == [("AI", "Inbox/b.md"), ("Keep", "Else/z.md")]


def test_cost_of_media(spark):
    df = spark.createDataFrame([("x" * 1000, 600.0, True), ("", None, False)], "text string, duration_seconds double, has_transcript boolean")
    a, b = cost.cost_ledger(df).collect()
    assert a["asr_usd"] == 0.06 and a["duration_minutes"] == 10.0 and not a["over_budget"]
    assert b["asr_usd"] == 0.0 and b["duration_minutes"] == 10.0 and b["summary_usd"] == 0.00054


def test_let_keeps_trees_small(spark):
    c = F.col("t")
    for _ in range(6):
        c = tx.clip(tx.squash(c), 50)
    size = len(spark.createDataFrame([("a b",)], "t string").select(c)._jdf.queryExecution().optimizedPlan().toString())
    assert size < 20_000


def test_report_sections_are_stored_in_order(spark, tmp_path):
    from gleaner.sources import writers

    rows = [(f"c{k:02}", s, k % 3 > 0, k / 4, "pass" if k % 3 else "extract", [] if k % 3 else ["m"]) for k in range(20) for s in ("a", "b") if (k, s) != (5, "b")]
    df = spark.createDataFrame(rows, "case_id string, stage string, passed boolean, overall_score double, root_cause string, missing array<string>")
    writers.write_sections(reports.progressive_report(df, ["a", "b"]), str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert lines[:5] == ["# Progressive Validation Report", "## Stage Summary", "| stage | case_count | pass_count | pass_rate |", "| a | 20 | 13 | 0.65 |", "| b | 19 | 12 | 0.6316 |"]
    assert lines[5:8] == ["## Case Matrix", "| case_id | a (pass/score/root) | b (pass/score/root) |", "| c00 | false / 0.0 / extract | false / 0.0 / extract |"]
    assert "| c05 | true / 1.25 / pass | N/A |" in lines and lines[27] == "## Failing Cases" and lines[28] == "a - c00: extract | missing=m"
    assert len(lines) == 5 + 22 + 1 + 14


def test_empty_document_is_partial_evidence(spark):
    from gleaner.operators import evidence, validation

    df = spark.createDataFrame([(1, '{"title": "T", "summary": "S", "sections": [{"content": "see https://github.com/a/b now"}]}', "more"), (2, "{}", None)], "k int, j string, extra string")
    df = validation.check(df, "j").selectExpr("k", "document", "extra", "'https://e.com' AS source_url", "cast(null AS array<string>) AS warnings")
    rows = {r.k: r for r in evidence.document_evidence(df, extra="extra").collect()}
    assert rows[1].text.endswith("see https://github.com/a/b now\n\n[搜索补充]\nmore") and rows[1].coverage == "full" and rows[1].fetch_warnings == []
    assert rows[1].signals.projects == ["a/b"] and rows[2].coverage == "partial"
