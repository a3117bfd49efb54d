"""Properties that hold for any input, and plans that keep their shape."""

from __future__ import annotations

import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.functions import arrays as ar
from gleaner.functions import text as tx
from gleaner.functions import urls
from gleaner.operators import compaction, evaluation, keyed, lines, notes, sampling, signals

WORDS = st.lists(st.sampled_from(["the ab", "THE AB", "x", "", "  y ", "[00:01] token", "https://github.com/a/b", "12:30", "中文 行"]), max_size=30)
FAST = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@FAST
@given(WORDS)
def test_first_by_key_matches_a_plain_loop(spark, words):
    df = spark.createDataFrame([("\n".join(words),)], "t string")
    got = df.select(lines.first_by_key(ar.lines(F.col("t")), tx.token).alias("o")).first()["o"]
    want, seen = [], set()
    for word in (w.strip() for w in words):
        key = " ".join(word.split()).lower()
        if word and key not in seen:
            seen.add(key)
            want.append(word)
    assert got == want


@FAST
@given(WORDS, st.integers(800, 900))
def test_compaction_never_exceeds_its_budget(spark, words, budget):
    df = spark.createDataFrame([("\n".join(words * 20),)], "text string")
    out = compaction.compact_evidence(df, max_lines=30, max_chars=budget).first()["compact"]
    assert out["kept_chars"] <= budget and out["kept_lines"] <= 30


def test_canonical_url_is_idempotent(spark):
    raw = ["https://A.com", "http://a.com/b?utm_x=1&c=%20d+e#f", "x", "https://a.com/?b=ü&&=1&k", "ftp://H/p"]
    df = spark.createDataFrame([(u,) for u in raw], "u string").withColumn("a", urls.canonical_url(F.col("u")))
    assert df.filter(urls.canonical_url(F.col("a")) != F.col("a")).count() == 0


def test_per_document_rules_need_no_exchange(spark):
    df = spark.createDataFrame([(1, "a\nb", None)], "doc_id bigint, text string, source_url string")
    df = compaction.compact_evidence(signals.extract_signals(df))
    assert "Exchange" not in plan(df)


def test_results_do_not_depend_on_partitioning(spark):
    rows = [(i, f"k{i % 3}", f"v{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "i bigint, k string, v string").withColumn("o", F.col("i"))
    for fn in (keyed.distinct_first, keyed.distinct_last):
        a = {tuple(r) for r in fn(df.repartition(1), ["k"], ["o"]).collect()}
        assert a == {tuple(r) for r in fn(df.repartition(7, "v"), ["k"], ["o"]).collect()}


def test_salted_lookup_equals_a_plain_join(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)], "i bigint, k string")
    look = spark.createDataFrame([("hot", 1), ("k0", 2), ("none", 3)], "k string, n int")
    for how in ("left", "inner"):
        want = {tuple(r) for r in facts.join(look, "k", how).select("i", "k", "n").collect()}
        got = keyed.salted_lookup(facts, look, ["k"], how, salts=5).select("i", "k", "n").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("blocks", [1, 3])
def test_phrase_hits_equal_brute_force(spark, blocks):
    """In one block and in several, for long phrases, short phrases and single characters."""
    texts = ["the quick brown fox jumps over", "Quick  brown\nfox", "aa bb", "x", "over the lazy dog and on", "", "brown fox"]
    phrases = ["quick brown fox", "ck brown fo", "brown fox", "x", "the lazy dog and", "bb", "zzz", "he quick brown fox jumps ov", "o"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    table = spark.createDataFrame(list(enumerate(phrases)), "pid bigint, phrase string")
    got = evaluation.phrase_hits(docs, table, "doc_id", "text", "pid", "phrase", max_keys=1 << 16 if blocks == 1 else 3)
    norm = [" ".join(t.split()).lower() for t in texts]
    want = {(i, j) for i, p in enumerate(phrases) for j, t in enumerate(norm) if p in t}
    assert {tuple(r) for r in got.collect()} == want


def test_phrase_hits_read_the_texts_once_and_leave_them_in_place(spark, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "concat('text number ', id) AS text").write.parquet(f"{tmp_path}/d")
    table = spark.createDataFrame([(1, "text number 4"), (2, "er 1")], "pid bigint, phrase string")
    got = evaluation.phrase_hits(spark.read.parquet(f"{tmp_path}/d"), table, "doc_id", "text", "pid", "phrase")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any("_t#" in line or "text#" in line for line in moved)
    assert got.count() == 11 + 11


def test_duplicates_of_a_hot_group(spark):
    rows = [(f"p{i:03d}", "https://e.com" if i % 3 else None, f"t{i % 5}", "body") for i in range(120)]
    df = spark.createDataFrame(rows, "path string, source_url string, title string, raw_evidence string")
    groups = {}
    for path, url, title, body in rows:
        groups.setdefault(url or (title, body), []).append(path)
    want = {(p, max(g)) for g in groups.values() for p in g if p != max(g)}
    assert {tuple(r) for r in notes.duplicate_notes(df).collect()} == want
    assert notes.dedup_notes(df).count() == len(groups)


def test_sampling_respects_its_quotas(spark):
    rows = [(f"https://x/{i:03d}", f"f{i % 3}", f"f{i % 3}_{i % 4}", "successful" if i % 5 else "partial_but_usable") for i in range(60)]
    df = spark.createDataFrame(rows, "source_url string, family string, bucket string, classification string")
    out = sampling.sample_candidates(df, 14, 5).collect()
    per = {}
    for r in out:
        per[r["family"]] = per.get(r["family"], 0) + 1
    assert len(out) == 14 and max(per.values()) <= 5 and len({r["source_url"] for r in out}) == 14


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_scans_read_only_what_they_need(spark):
    import __spark_entry__ as entry

    text = plan(entry.queries()["cost_totals"](spark, "/root/testdata/sf0.001"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text
    text = plan(entry.queries()["stage_matrix"](spark, "/root/testdata/sf0.001"))
    assert "PushedFilters: [In(event_type" in text
