"""Ranking by shared tokens, exact without an exchange of pairs."""

from __future__ import annotations

import random
import re

import pytest

from gleaner.operators import evaluation, search


def brute(queries, docs, limit, stop):
    find = lambda t: list(dict.fromkeys(re.findall(r"[A-Za-z0-9][A-Za-z0-9._\-]{1,}|[一-鿿]{2,10}", t or "")))
    out = []
    for q, text in queries:
        asked = {t for t in find(text) if t.lower() not in stop}
        scored = sorted((-len(asked & set(find(d))), i is not None, i or 0, i) for i, d in docs)
        out += [(q, i, -n, r) for r, (n, _, _, i) in enumerate(scored[:limit], 1) if n < 0]
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 300])
def test_top_documents_equal_brute_force(spark, batch_bytes):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["the", "漢字", "a.b-c"]
    make = lambda n: " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, make(rng.randint(0, 30))) for k in range(300)] + [(None, "w0 w1 w2 w3"), (7, None), (900, "w5 w6"), (899, "w5 w6")]
    queries = [(f"q{k}", make(rng.randint(1, 9))) for k in range(20)] + [("none", None), ("stop", "the"), ("odd", "zzz")]
    q = spark.createDataFrame(queries, "id string, q string")
    d = spark.createDataFrame(docs, "doc long, t string").repartition(3)
    got = search.rank_corpus(q, d, "id", "doc", "q", "t", limit=4, stop=("the",), batch_bytes=batch_bytes)
    assert sorted(map(tuple, got.select("id", "doc", "hits", "rank").collect()), key=repr) == brute(queries, docs, 4, {"the"})
    assert search.rank_corpus(q, d.limit(0), "id", "doc", "q", "t").count() == 0
    assert search.rank_corpus(q.limit(0), d, "id", "doc", "q", "t").count() == 0


def test_pairs_do_not_move(spark):
    q = spark.createDataFrame([("a", "common rare")], "id string, q string")
    d = spark.range(2000).selectExpr("id AS doc", "'common common' AS t").repartition(4)
    found = search.rank_corpus(q, d, "id", "doc", "q", "t", limit=3)
    rows = found.collect()
    assert [(r.doc, r.hits, r["rank"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_number" in plan and "hashpartitioning(id" not in plan.replace("hashpartitioning(_number", "")


def test_phrase_keys_in_blocks(spark):
    docs = spark.createDataFrame([(k, f"x{k} one two three y{k} tail{k % 7}") for k in range(60)], "d long, t string")
    phrases = spark.createDataFrame([(k, f"one two three y{k}") for k in range(60)] + [(100, "tail3"), (101, "no such")], "p long, s string")
    whole = sorted(map(tuple, evaluation.phrase_hits(docs, phrases, "d", "t", "p", "s").collect()))
    assert sorted(map(tuple, evaluation.phrase_hits(docs, phrases, "d", "t", "p", "s", max_keys=2).collect())) == whole
    assert (100, 3) in whole and (5, 5) in whole
