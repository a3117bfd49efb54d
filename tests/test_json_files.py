"""Split JSON arrays, nested harvest and strict validation."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import validation
from gleaner.sources import json_files, readers

SCHEMA = "id BIGINT, text STRING, inner STRUCT<a: ARRAY<STRING>, b: STRUCT<c: STRING>>"


def objects(n, seed=1):
    rng = random.Random(seed)
    bits = ["}", "{", "[", "]", '"', "\\", "\\\"", ",", ":", "é🙂", "\n", "text", " ", "},{", '"}', "\\\\"]
    make = lambda: "".join(rng.choices(bits, k=rng.randint(0, 25)))
    return [{"id": k, "text": make(), "inner": {"a": [make() for _ in range(rng.randint(0, 3))], "b": {"c": make()}}} for k in range(n)]


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "4096")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()))


def test_array_is_read_by_many_tasks_and_equals_multiline(spark, tmp_path, small_splits):
    made = objects(400)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps(made, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "a/pretty.json").write_text("﻿\n " + json.dumps(made[:50], indent=2) + "\n\n", encoding="utf-8")
    (tmp_path / "a/empty.json").write_text(" [ ]\n")
    path = str(tmp_path / "a")
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 20
    got = json_files.read_objects(spark, path, SCHEMA)
    assert rows(got.drop("_path", "_ord")) == sorted(json.dumps(m, sort_keys=True) for m in [*made, *made[:50]])
    whole = spark.read.schema(SCHEMA).json(f"{path}/one.json", multiLine=True)
    assert rows(got.where(F.endswith("_path", F.lit("one.json"))).drop("_path", "_ord")) == rows(whole)
    ordered = got.where(F.endswith("_path", F.lit("one.json"))).orderBy("_ord").select("id", "_ord").collect()
    assert [(r.id, r._ord) for r in ordered] == [(k, k) for k in range(400)]


def test_objects_behind_one_another_and_other_elements(spark, tmp_path, small_splits):
    made = objects(120, 2)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(m) for m in made))
    assert rows(json_files.read_objects(spark, str(tmp_path / "lines.json"), SCHEMA).drop("_path", "_ord")) == sorted(json.dumps(m, sort_keys=True) for m in made)
    (tmp_path / "mixed.json").write_text('[1, {"id": 1}, "}", {"id": 2}, null, {"id": 3')
    assert sorted(r.id for r in json_files.read_objects(spark, str(tmp_path / "mixed.json"), SCHEMA).collect()) == [1, 2]


def test_harvest_reaches_any_depth(spark):
    deep = {"source_url": "https://e.com/0"}
    for k in range(1, 40):
        deep = {"source_url": f"https://e.com/{k}", "source_kind": k if k % 2 else f" k{k} ", "x": [deep, {"source_url": 5}, {"source_url": "  "}]}
    texts = [json.dumps(deep), "{broken", None, "[]", '"source_url"', '{"a.b": {"source_url": "u", "source_kind": null}}']
    df = spark.createDataFrame(list(enumerate(texts)), "k long, value string")
    got = {(r.source_url, r.source_kind) for r in json_files.harvest(df, "value", ["k"]).collect()}
    assert got == {(f"https://e.com/{k}", f"k{k}" if k % 2 == 0 and k else None) for k in range(40)} | {("u", None)}


def test_readers_take_split_arrays(spark, tmp_path, small_splits):
    many = [{"id": f"c{k}", "source_kind": "url" if k % 5 else "", "raw_text": "} ] \" {" * 20, "expect": {"required_keywords": ["k", " "]}} for k in range(300)]
    path = tmp_path / "cases.json"
    path.write_text(json.dumps(many))
    good, bad = readers.read_eval_cases(spark, str(path))
    assert good.count() == 240 and bad.count() == 60
    replay = tmp_path / "replay.json"
    replay.write_text(json.dumps([{"case_id": f"r{k}", "entry_context": {"chat_target": "x"}, "payload": {"source_kind": "url", "raw_text": "}{" * 9}} for k in range(200)]))
    found = readers.read_replay_cases(spark, str(replay)).select("case_id", "ord", "raw_text").orderBy("ord").collect()
    assert [r.case_id for r in found] == [f"r{k}" for k in range(200)] and found[7].raw_text == "}{" * 9


CASES = [
    ({"title": " T ", "summary": "S"}, [], False),
    ({"title": None, "summary": "S"}, [("$.title", "missing")], True),
    ({"summary": []}, [("$.summary", "wrong_type"), ("$.title", "missing")], True),
    ([], [("$", "not_object")], True),
    ({"title": 5, "summary": True, "sections": {}}, [("$.sections", "wrong_type")], False),
    ({"title": "T", "summary": "S", "sections": [{"content": "c", "level": 1.5}, {"content": " "}, None, "x"]},
     [("$.sections[0].level", "wrong_type"), ("$.sections[1].content", "missing"), ("$.sections[2]", "not_object"), ("$.sections[3]", "not_object")], False),
    ({"title": "T", "summary": "S", "tables": [{"rows": [["a", None, 1], 5, []], "headers": ["h", " ", 2]}], "videos": [{"src": "v", "frame_summaries": "x", "duration_seconds": 3}]},
     [("$.videos[0].frame_summaries", "wrong_type")], False),
]


def test_documents_are_checked_field_by_field(spark):
    df = spark.createDataFrame([(k, json.dumps(c[0])) for k, c in enumerate(CASES)] + [(99, "{"), (98, None)], "k long, payload string")
    found = {r.k: r for r in validation.check(df, "payload").collect()}
    for k, (_, errors, rejected) in enumerate(CASES):
        assert sorted((e.path, e.code) for e in found[k].errors) == sorted(errors), k
        assert found[k].rejected == rejected and (found[k].document is None) == rejected
    assert found[0].document.title == "T" and found[4].document.title == "5" and found[4].document.summary == "true"
    assert [s.content for s in found[5].document.sections] == ["c"] and found[5].document.sections[0].level is None
    table, video = found[6].document.tables[0], found[6].document.videos[0]
    assert table.rows == [["a", "", "1"], []] and table.headers == ["h", "2"] and table.caption is None
    assert video.duration_seconds == 3.0 and video.frame_summaries == []
    assert all(found[k].rejected and found[k].errors[0].code == "not_object" for k in (98, 99))
    assert validation.error_rows(validation.check(df, "payload"), ["k"]).where("rejected").select("k").distinct().count() == 5


def test_own_description(spark):
    spec = {"n": validation.Field("int", required=True), "tags": validation.Field("texts"), "kids": validation.Items({"x": validation.Field("number")})}
    df = spark.createDataFrame([('{"n": 1, "tags": ["a"], "kids": [{}, {"x": "1"}]}',), ('{"n": "1"}',)], "v string")
    found = {r.rejected: r for r in validation.check(df, "v", spec).collect()}
    kept, gone = found[False], found[True]
    assert kept.document.n == 1 and kept.document.tags == ["a"] and [k.x for k in kept.document.kids] == [None, None]
    assert [(e.path, e.code) for e in kept.errors] == [("$.kids[1].x", "wrong_type")]
    assert [(e.path, e.code) for e in gone.errors] == [("$.n", "wrong_type")]
