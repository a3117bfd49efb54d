from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import ranked
from tests.llm.helpers import ODD, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(docs, queries, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for q, text in queries:
        scored = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(
                ranked.weight(n_docs, df[t]) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def got(spark, docs, queries, top=50, batch_bytes=ranked.QUERY_BYTES, **options):
    index = ranked.build_index(docs, **options)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    return sorted(map(tuple, ranked.search(index, asked, top=top, batch_bytes=batch_bytes).collect()), key=repr)


def test_odd_rows(spark):
    queries = [(1, "the CAT and the mat"), (2, None), (3, ""), (4, "nowhere"), (1, "the CAT and the mat"), (None, "Straße w3 x17 le")]
    docs = table(spark, ODD)
    want = brute([(r[0], r[1]) for r in ODD], queries)
    assert got(spark, docs, queries) == want
    assert got(spark, docs.repartition(3), queries, segment_docs=2, block=2, batch_bytes=10) == want
    assert got(spark, docs.limit(0), queries) == []
    assert got(spark, docs, queries[1:4]) == []


def test_equal_to_brute_force_over_segments_and_batches(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(0, 60)))) for i in range(900)]
    docs += [(i, "w0 W0, w1" * 400) for i in (5000, 4000)] + [(6000 + i, "w9 w8 w7") for i in range(200)]  # ties
    queries = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(40)] + [(99, "w9"), (98, "w0 w1 w2 w3 w250")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, queries, 10)
    assert got(spark, df, queries, top=10, segment_docs=64, block=8) == want
    assert got(spark, df, queries, top=10, block=16, batch_bytes=600) == want


def test_blocks_are_rejected_before_decompression():
    segment = ranked.Segment()
    rng = random.Random(3)
    for i in range(4000):
        segment.add(i, (("common " if i % 4 else "") + " ".join(f"x{rng.randint(0, 500)}" for _ in range(20)) + (" rare rare" if 40 < i < 100 else "")).encode())
    owner, rows = segment.rows(0, 128)
    lists = ranked.Lists(owner.column("lengths")[0].as_py(), 4000, 4000 * 21)
    found = {r["term"]: r for r in rows.to_pylist()}
    for code, word in enumerate((b"common", b"rare")):
        r = found[word]
        lists.add(code, ranked.weight(4000, r["df"]), r["header"], r["data"])
    docs, score = lists.search([0, 1], 0)
    assert len(docs) == 3014
    worst = int(np.sort(score)[-50])
    fresh = ranked.Lists(owner.column("lengths")[0].as_py(), 4000, 4000 * 21)
    for code, word in enumerate((b"common", b"rare")):
        r = found[word]
        fresh.add(code, ranked.weight(4000, r["df"]), r["header"], r["data"])
    docs, again = fresh.search([0, 1], worst)
    assert sorted(again) == sorted(score[score >= worst])
    assert fresh.decoded <= 2  # of 24 blocks of the common word one at most


def test_wide_values_and_long_texts(spark):
    segment = ranked.Segment()
    segment.add(1, b"a " * 70_000 + b"b")
    for i in range(400):
        segment.add(i, b"c" if i not in (0, 399) else b"a d" * (i + 1))
    _, rows = segment.rows(5, 128)
    for r in rows.to_pylist():
        head = np.frombuffer(r["header"], ranked.HEADER)
        docs, tf = (np.concatenate(x) for x in zip(*(ranked.decode(h, r["data"]) for h in head)))
        assert len(docs) == r["df"] and (np.diff(docs) > 0).all()
        if r["term"] == b"a":
            assert (list(docs), list(tf)) == ([0, 1, 400], [70_000, 1, 1])
    text = "word " * 600_000 + "unique end"
    assert sum(len(terms(p.decode())) for p in ranked.pieces(text.encode(), 1000)) == 600_002
    docs = spark.createDataFrame([(1, text), (2, "é" * 3_000_000), (3, "unique")], "doc_id long, text string")
    assert got(spark, docs, [(1, "unique word"), (2, "é" * 3_000_000)]) == brute([(1, text), (2, "é" * 3_000_000), (3, "unique")], [(1, "unique word"), (2, "é" * 3_000_000)])


def test_ordinals_are_bounded(spark):
    with pytest.raises(ValueError):
        ranked.build_index(table(spark, ODD), segment_docs=1 << 17)
