"""Input schemas as DDL."""

from __future__ import annotations

REQUEST = (
    "chat_id STRING, reply_to_message_id STRING, request_id STRING, source_kind STRING, source_url STRING, raw_text STRING, "
    "image_refs ARRAY<STRING>, platform_hint STRING, requested_output_lang STRING, dry_run BOOLEAN, "
    "video_probe_seconds INT, force_full_video BOOLEAN"
)
EXPECT = (
    "required_keywords ARRAY<STRING>, required_links ARRAY<STRING>, required_projects ARRAY<STRING>, "
    "required_skill_ids ARRAY<STRING>, required_skills ARRAY<STRING>, required_actions ARRAY<STRING>, "
    "require_action_checklist BOOLEAN, forbidden_phrases ARRAY<STRING>, min_evidence_chars INT"
)


def _struct(ddl: str) -> str:
    parts, depth, start, out = ddl, 0, 0, []
    for i, ch in enumerate(parts + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = parts[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return "STRUCT<" + ", ".join(out) + ">"


EVAL_CASE = (
    "id STRING, case_id STRING, source_kind STRING, source_url STRING, raw_text STRING, platform_hint STRING, "
    f"image_refs ARRAY<STRING>, video_probe_seconds INT, force_full_video BOOLEAN, expect {_struct(EXPECT)}"
)
RECOGNITION_CASE = (
    "id STRING, case_id STRING, source_kind STRING, source_url STRING, raw_text STRING, platform_hint STRING, provenance STRING, "
    f"labels ARRAY<STRING>, expect {_struct(EXPECT)}, auto_reason STRING"
)
REPLAY_CASE = (
    "case_id STRING, entry_context STRUCT<chat_target: STRING, entry_mode: STRING>, "
    f"payload {_struct(REQUEST)}, expect {_struct(EXPECT)}"
)
JOB = (
    f"job_id STRING, status STRING, created_at STRING, updated_at STRING, request {_struct(REQUEST)}, message STRING, "
    "result STRING, error STRING, warnings ARRAY<STRING>, phase_status MAP<STRING, STRING>, "
    "notification STRUCT<attempted: BOOLEAN, ok: BOOLEAN, error: STRING>"
)
SUMMARY = (
    "title STRING, primary_topic STRING, secondary_topics ARRAY<STRING>, entities ARRAY<STRING>, conclusion STRING, "
    "bullets ARRAY<STRING>, evidence_quotes ARRAY<STRING>, coverage STRING, confidence STRING, note_tags ARRAY<STRING>, "
    "follow_up_actions ARRAY<STRING>, timeliness STRING, effectiveness STRING, recommendation_level STRING, reader_judgment STRING"
)
PHASE_EVENT = "job_id BIGINT, seq BIGINT, phase STRING, state STRING, warning STRING"
