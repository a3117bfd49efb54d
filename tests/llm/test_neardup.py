from __future__ import annotations

import math
import random

import numpy as np
import pytest

from gleaner.llm import components as cc
from gleaner.llm import neardup as nd

from .helpers import ODD, as_rows, table


def plain_set(text, k=nd.SHINGLE):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, percent=nd.PERCENT):
    """(id, set size, component) by comparing all pairs."""
    sets = [plain_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(mates, default=None) if sets[i] else r[0]))
    return sorted(out, key=repr)


def near_copies(seed, families=6, size=12):
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(families):
        base = [f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 140))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
            text = " ".join(words)
            rows.append((at, text.upper() if rng.random() < 0.2 else text, "en", "s", 1))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [nd.CHUNK, 3])
def test_groups_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rows = near_copies(5) + [(1000 + (r[0] or 0), *r[1:]) for r in ODD if r[0] != 7] + [(None, "lonely text with no id here", "en", "s", 1)]
    got = nd.group(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stage_keeps_one_of_each_group(spark):
    rows = near_copies(8, families=3) + [(1000 + (r[0] or 0), *r[1:]) for r in ODD]
    df = table(spark, rows)
    kept = nd.deduplicate(df)
    assert kept.columns == df.columns
    want = [r for r in brute(rows) if r[0] == r[2]]
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({r[0] for r in want})  # the repeated row is there once
    assert set(as_rows(kept)) <= set(as_rows(df))
    assert nd.deduplicate(table(spark, [])).collect() == []


def test_estimate_is_close_to_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.9):
        errors = []
        for _ in range(12):
            both, rest = int(1000 * share), 1000 - int(1000 * share)
            h = nd.mix(rng.integers(0, 2**63, 1000, np.uint64))
            a, b = h[: both + rest // 2], np.concatenate([h[:both], h[both + rest // 2 :]])
            x, y = nd.sketch(a), nd.sketch(b)
            j = nd.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(j - both / (len(a) + len(b) - both))
        assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.04


def test_bands_and_estimate_together_hardly_miss_a_pair_at_the_threshold():
    """Both misses of a pair of equal sizes at the threshold, the estimate's as a binomial tail over the registers."""
    j = nd.PERCENT / 100
    equal = float(1 - 2 * nd._p(np.array((1 - j) / 2)))
    d0 = np.arange(nd.M + 1)
    larger = (nd.M - d0) // 2
    found = nd.estimate(larger, nd.M - d0 - larger, np.full(len(d0), 1000), np.full(len(d0), 1000))
    chance = [math.comb(nd.M, int(d)) * equal**int(d) * (1 - equal) ** (nd.M - int(d)) for d in d0]
    lost = sum(p for p, x in zip(chance, found) if x < j - nd.SLACK)
    assert (1 - equal**nd.ROWS) ** nd.BANDS + lost < 1e-6


def test_sketches_merge_by_maximum():
    h = nd.mix(np.arange(500, dtype=np.uint64))
    assert (np.maximum(nd.sketch(h[:300]), nd.sketch(h[200:])) == nd.sketch(h)).all()


def test_components_equal_plain_search(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 90), rng.randint(50, 90)) for _ in range(25)] + [(7, 7), (None, 3), (95, 94)]
    got = {r.node: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
