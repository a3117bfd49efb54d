"""Nothing is cut in silence: long inputs and wide ids come through whole."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleaner.operators import compaction, segments, steps, summaries
from gleaner.plans import note_queries


def test_note_names_of_nine_digit_ids_differ(spark, tmp_path):
    ids = [7, 12345678, 123456780, 123456789]
    spark.createDataFrame([(i, "t", "en", "s", 1) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names = {r.doc_id: r.note for r in note_queries.note_table(spark, str(tmp_path)).collect()}
    assert len(set(names.values())) == len(ids)
    assert names[7] == "Inbox/00000007.md" and names[123456789] == "Inbox/123456789.md"


def test_five_thousand_segments(spark):
    payload = json.dumps({"segments": [{"text": f"line {i}", "start": i, "end": i + 1} for i in range(5000)]})
    df = spark.createDataFrame([(payload,)], "p string")
    t = segments.parse_transcripts(df, "p").first().transcript
    assert len(t.timeline) == 5000 and t.text.endswith("line 4999") and t.duration_seconds == 4999
    short = segments.parse_transcripts(df, "p", timeline_limit=3).first().transcript
    assert len(short.timeline) == 3 and short.text == t.text
    asr = segments.normalize_transcription(df, "p").first().asr
    assert asr.duration_seconds == 5000.0 and len(asr.segments) == 5000 and asr.text.endswith("line 4999")


def test_late_lines_count(spark):
    lines = [f"[{i // 60:02d}:{i % 60:02d}] plain talk number {i}" for i in range(900)] + ["[15:00] github release with 3 commands and an API key point"]
    df = spark.createDataFrame([(lines,)], "x array<string>")
    got = df.select(compaction.timeline_highlights(F.col("x"), limit=1000)).first()[0]
    assert lines[-1] in got


def test_steps_beyond_thirty_and_long_lines(spark):
    text = "\n".join(f"步骤 {i} 打开" for i in range(50)) + "\n" + "字" * 300 + " 一、打开设置"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(steps.step_lines(F.col("t"))).first()[0]
    assert len(got) == 51 and got[-1].startswith("一、")


def test_search_section_is_appended_to_many(spark):
    section = "struct<heading:string,level:int,content:string>"
    df = spark.range(1).select(F.expr(f"named_struct('title', 't', 'summary', 's', 'sections', transform(sequence(1, 8), i -> cast(named_struct('heading', 'h', 'level', 1, 'content', 'c') as {section})), 'images', array('i'), 'videos', array('v'), 'tables', array('t'))").alias("d"))
    got = df.select(summaries.extend_document(F.col("d"), F.lit("found on the web")).alias("d")).first().d
    assert len(got.sections) == 9 and got.sections[-1].content == "found on the web"
