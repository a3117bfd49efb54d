"""Readers, writers and streams on small files."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from gleaner import schemas
from gleaner.functions import arrays as ar
from gleaner.operators import hooks
from gleaner.session import checkpoint_dir, cut_lineage
from gleaner.sources import readers, versions, writers
from gleaner.streaming import ingest, ledger


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_requests_get_defaults(spark, tmp_path):
    path = dump(tmp_path / "r.json", '{"chat_id":"-1","source_kind":"url","source_url":"https://e.com"}\n{"request_id":"x","dry_run":true}')
    rows = {r["source_kind"]: r for r in readers.read_requests(spark, path).collect()}
    assert rows["url"]["requested_output_lang"] == "zh-CN" and rows["url"]["image_refs"] == [] and not rows["url"]["dry_run"]
    assert len(rows["url"]["request_id"]) == 36 and rows[None]["request_id"] == "x" and rows[None]["dry_run"]


def test_eval_cases_are_checked(spark, tmp_path):
    path = dump(tmp_path / "c.json", [
        {"id": "a", "source_kind": "url", "expect": {"required_keywords": ["k", " "], "min_evidence_chars": 0}},
        {"source_kind": "url"}, {"id": "b"},
    ])
    good, bad = readers.read_eval_cases(spark, path)
    row = good.first()
    assert row["case_id"] == "a" and row["expect"]["required_keywords"] == ["k"] and row["expect"]["min_evidence_chars"] == 1
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["missing id", "missing source_kind"]


def test_recognition_and_replay_cases(spark, tmp_path):
    manual = dump(tmp_path / "m.json", [{"source_kind": "url", "source_url": "https://e.com", "labels": ["a", "a"]}, {"source_kind": "image"}])
    auto = dump(tmp_path / "a.jsonl", '{"source_kind":"video_url","source_url":"https://v.com","auto_reason":"x"}\n')
    good, bad = readers.read_recognition_cases(spark, manual, "manual")
    assert good.first()["labels"] == ["a"] and good.first()["id"].startswith("auto-https-e-com-") and bad.count() == 1
    assert good.first()["provenance"] == "manual" and good.first()["auto_reason"] == ""
    assert readers.read_recognition_cases(spark, auto, "auto").good.first()["id"].startswith("auto-")
    replay = dump(tmp_path / "p.json", [{"case_id": "r", "entry_context": {"chat_target": "group_chat"}, "payload": {"source_kind": "url"}, "expect": {}}])
    row = readers.read_replay_cases(spark, replay).first()
    assert row["case_id"] == "r" and row["chat_target"] == "group_chat" and row["source_kind"] == "url"


NOTE = "---\ntitle: My note\nsource_url: https://e.com/a\n---\n\n[[Topics/AI/AI Index.md]]\n\n## 原始证据\nline one\nline two\n## Next\nx\n"


def test_notes(spark, tmp_path):
    dump(tmp_path / "v/2026/01/a.md", NOTE)
    dump(tmp_path / "v/2026/01/b.md", "<!-- source_url: https://e.com/b -->\nbody")
    dump(tmp_path / "v/_Archive/c.md", NOTE)
    rows = {r["title"]: r for r in readers.read_notes(spark, str(tmp_path / "v")).collect()}
    assert set(rows) == {"My note", "b"}
    assert rows["My note"]["raw_evidence"] == "line one\nline two" and rows["My note"]["topic_names"] == ["AI"]
    assert rows["b"]["source_url"] == "https://e.com/b"


def test_jobs_vtt_snapshots_urls(spark, tmp_path):
    jobs = dump(tmp_path / "j/1.json", {"job_id": "1", "phase_status": {"extract": "done"}})
    row = readers.read_jobs(spark, jobs).first()
    assert row["phase_status"] == {"extract": "done", "summarize": "pending", "write_note": "pending", "notify": "pending"}
    assert row["warnings"] == [] and row["notification"]["attempted"] is False
    vtt = dump(tmp_path / "x.vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\nhi\n")
    assert [(r["start"], r["text"]) for r in readers.read_vtt(spark, vtt).collect()] == [(1.0, "hi")]
    snap = dump(tmp_path / "s.log", '- heading "H"\n  - text: body\n  - /url: https://e.com\n')
    assert [r["kind"] for r in readers.read_snapshot_lines(spark, snap).orderBy("pos").collect()] == ["heading", "text", "url"]
    nested = dump(tmp_path / "n.json", {"a": [{"payload": {"source_url": "https://e.com/1", "source_kind": "url"}}, {"source_url": "https://e.com/2"}]})
    prose = dump(tmp_path / "p.md", "see https://e.com/3. and (https://e.com/4)")
    got = {(r["source_url"], r["source_kind"]) for r in readers.harvest_urls(spark, [nested], [prose]).collect()}
    assert got == {("https://e.com/1", "url"), ("https://e.com/2", None), ("https://e.com/3", None), ("https://e.com/4", None)}


def test_upsert_keeps_the_last_write(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "source_url string, created_at string, summary string"
    writers.write_cache(spark.createDataFrame([("u", "1", "old"), ("u", "2", "mid"), ("", "3", "none"), ("w", "1", "w")], schema), path)
    writers.write_cache(spark.createDataFrame([("u", "3", "new")], schema), path)
    got = {r["source_url"]: r["summary"] for r in writers.read_latest(spark, path, ["source_url"]).collect()}
    assert got == {"u": "new", "w": "w"}


def test_auto_cases_are_appended_once(spark, tmp_path):
    found = spark.createDataFrame([("k", "r"), ("k", "r"), ("k", "s")], "case_key string, auto_reason string")
    for _ in range(2):
        writers.append_auto_cases(found, str(tmp_path / "inbox"))
    assert writers.read_inbox(spark, str(tmp_path / "inbox")).count() == 2
    assert versions.read(spark, str(tmp_path / "inbox")).count() == 2


def test_other_sinks(spark, tmp_path):
    results = spark.createDataFrame([("b", True, 0.9, "pass", 0.5), ("a", False, 0.1, "extract", 0.25)],
                                    "case_id string, passed boolean, overall_score double, root_cause string, total_cost_usd double")
    writers.write_report(results, str(tmp_path / "rep"))
    assert spark.read.json(str(tmp_path / "rep/totals")).first()["pass_rate"] == 0.5
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "rep/table")).collect())[0] == "| a | false | 0.1 | extract |"
    edges = spark.createDataFrame([("n1", "topic", "AI"), ("n1", "topic", "AI"), ("n2", "entity", "X")], "note string, kind string, target string")
    writers.write_indexes(edges, str(tmp_path / "idx"), topic="target")
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 2
    notes = spark.createDataFrame([("p", "c")], "path string, content string").withColumn("captured_at", F.lit("2026-03-17").cast("timestamp"))
    writers.write_notes(notes, str(tmp_path / "notes"))
    writers.write_notes(notes.withColumn("content", F.lit("again")), str(tmp_path / "notes"))
    rows = writers.read_latest(spark, str(tmp_path / "notes"), ["path"]).collect()
    assert [(r["path"], r["content"], r["year"], r["month"]) for r in rows] == [("p", "again", "2026", "03")]
    mats = spark.createDataFrame([("t", "one"), ("t", "two"), ("u", "x")], "title string, body string")
    writers.write_materials(mats, str(tmp_path / "mat"))
    assert writers.read_latest(spark, str(tmp_path / "mat"), ["material_key"]).count() == 2
    assert writers.manifest(spark, str(tmp_path / "notes"), "*.parquet").count() >= 1


EVENTS = [
    (1, 1, "extract", "processing", None), (1, 2, "extract", "done", "slow page"), (1, 3, "summarize", "done", None), (1, 4, "notify", "done", "slow page"),
    (2, 1, "extract", "processing", None), (2, 2, "extract", "failed", None), (3, 5, "notify", "done", None),
]


def test_ledger_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    # Two files: the second brings earlier sequence numbers, as late events do.
    for i, part in enumerate((EVENTS[3:], EVENTS[:3])):
        lines = "\n".join(json.dumps(dict(zip(("job_id", "seq", "phase", "state", "warning"), e))) for e in part)
        (folder / f"{i}.json").write_text(lines)
    batch = ledger.final_ledger(spark.read.schema(schemas.PHASE_EVENT).json(str(folder)))
    want = {r["job_id"]: (r["n_events"], r["status"], r["phases"], r["warnings"], r["failed_phase"]) for r in batch.collect()}
    assert want[1][1] == "completed_with_warnings" and want[1][3] == ["slow page"]
    assert want[2][1] == "failed" and want[2][4] == "extract" and want[3][1] == "done"
    assert want[3][2]["extract"] == "pending"
    stream = spark.readStream.schema(schemas.PHASE_EVENT).option("maxFilesPerTrigger", 1).json(str(folder))
    run = (
        ledger.stream_ledger(stream, str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "chk"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    rows = ledger.read_ledger(spark, str(tmp_path / "out")).collect()
    assert {r["job_id"]: (r["n_events"], r["status"], r["phases"], r["warnings"], r["failed_phase"]) for r in rows} == want


def test_ingest_replay_and_cache(spark, tmp_path):
    folder = tmp_path / "in"
    dump(folder / "1.json", '{"request_id":"a","source_kind":"url","source_url":"https://E.com/x?utm_source=y"}')
    dump(folder / "2.json", '{"request_id":"b","source_kind":"pasted_text","raw_text":"hello"}')
    run = ingest.replay(spark, str(folder), ingest.queued_jobs, str(tmp_path / "jobs"), str(tmp_path / "c1"))
    run.awaitTermination()
    jobs = {r["job_id"]: r for r in versions.read(spark, str(tmp_path / "jobs")).collect()}
    assert set(jobs) == {"a", "b"} and jobs["a"]["status"] == "received" and jobs["a"]["phase_status"]["notify"] == "pending"
    cache = spark.createDataFrame([("https://e.com/x", "fp", "s")], "source_url string, fingerprint string, summary string").withColumn("created_at", F.lit(datetime.now(timezone.utc)))
    hits = ingest.fresh_cache_hits(ingest.request_stream(spark, str(folder)), cache)
    run = hits.writeStream.format("memory").queryName("hits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    run.awaitTermination()
    got = {r["request_id"]: r["summary"] for r in spark.table("hits").collect()}
    assert got == {"a": "s", "b": None}


def test_hooks(spark):
    def engine(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "title": b["text"].str.upper(), "primary_topic": "t", "secondary_topics": [[]] * len(b), "entities": [[]] * len(b),
                "conclusion": "c", "bullets": [["x"]] * len(b), "evidence_quotes": [[]] * len(b), "coverage": "full", "confidence": "high",
                "note_tags": [[]] * len(b), "follow_up_actions": [[]] * len(b), "timeliness": "low", "effectiveness": "low",
                "recommendation_level": "skip", "reader_judgment": "",
            })

    df = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    assert hooks.summarize_with(df, engine).first()["s"]["title"] == "ABC"
    tracks = spark.createDataFrame([(1, "subtitle", "s"), (1, "audio", "a")], "doc_id bigint, track string, payload string")
    row = hooks.attach_tracks(df, tracks, "doc_id", ("subtitle", "audio", "ocr")).first()
    assert (row["subtitle"], row["audio"], row["ocr"]) == ("s", "a", None)


def test_lineage_is_cut_in_the_configured_folder(spark):
    assert checkpoint_dir(spark)
    assert cut_lineage(spark.range(3)).count() == 3


def test_arrays_fit(one):
    assert one(lambda d: ar.fits_prefix(F.array(F.lit(5), F.lit(4), F.lit(1)), 10)) == 2
    assert one(lambda d: ar.fits_prefix(F.array(F.lit(11), F.lit(1)), 10)) == 0
