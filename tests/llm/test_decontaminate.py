from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleaner.llm import decontaminate as dc
from gleaner.llm.common import alnum_words


def brute(words, items, window=dc.WINDOW):
    hit, ids = set(), set()
    for item_id, text in items:
        w = alnum_words((text or "").encode())
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit.update(range(j, j + m))
                    ids.add(item_id)
    return len(hit), sorted(i for i in ids if i is not None)


def fixture(seed=3):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "über", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(20)), (2, text(13)), (3, "beta gamma"), (4, None), (5, "!!"), (None, text(15)), (1, text(14)), (7, "x1")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(20)]
    docs += [(30, "zz " + items[0][1] + " yy"), (31, None), (32, ""), (33, "--"), (30, "zz " + items[0][1] + " yy"), (None, items[1][1])]
    return docs, items


def run(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    return [r for r in dc.scan(d, b, "found", **options).collect()]


def test_scan_equals_brute_force(spark):
    docs, items = fixture()
    for options in ({}, {"max_pattern_bytes": 200}):
        got = run(spark, docs, items, **options)
        assert len(got) == len(docs)
        for r in got:
            words = alnum_words((r.text or "").encode())
            n_hit, ids = brute(words, items)
            assert (r.n_words, r.found.n_words, r.found.n_hit, sorted(r.found["items"])) == ("clash", len(words), n_hit, ids)
            spans = r.found.spans
            assert sum(b - a for a, b in zip(spans[::2], spans[1::2])) == n_hit


def test_filter_keeps_clean_rows_whole(spark):
    docs, items = fixture()
    items = items[:2]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("decon", F.lit(1))
    kept = dc.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for doc_id, text in docs:
        words = alnum_words((text or "").encode())
        n, _ = brute(words, items)
        if not (n and 20 * n >= len(words)):
            want.append((doc_id, text, 1))
    assert sorted(map(tuple, kept), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert [r.found.n_hit for r in run(spark, [(1, "a b c")], [])] == [0]
