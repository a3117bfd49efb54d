from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import substrings as ss

from .helpers import ODD, table


def brute(rows, length, keep):
    where = {}
    for k, (doc_id, text) in enumerate(rows):
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            where.setdefault(data[i : i + length], []).append((doc_id is not None, doc_id or 0, hashlib.md5(data).hexdigest(), i, k))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        data = (text or "").encode()
        flags = bytearray(len(data))
        for i in range(len(data) - length + 1):
            at = where[data[i : i + length]]
            first = min(at)
            if len(at) > 1 and (keep == "none" or (doc_id is not None, doc_id or 0, hashlib.md5(data).hexdigest(), i) != first[:4]):
                flags[i : i + length] = b"\1" * length
        kept = bytes(c for c, f in zip(data, flags) if not f)
        spans = sum(1 for i in range(len(flags)) if flags[i] and (i == 0 or not flags[i - 1]))
        out.append((doc_id, len(data), flags.count(1), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def fixture(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [word(rng.randint(20, 90)) for _ in range(5)]
    rows = []
    for i in range(45):
        text = "".join(rng.choice(shared) if rng.random() < 0.4 else word(rng.randint(0, 60)) for _ in range(rng.randint(0, 6)))
        rows.append((i, text))
    return rows + [(50, rows[3][1]), (50, rows[3][1]), (51, "ab" * 150), (52, "a" * 200), (None, shared[0]), (53, None), (54, "")]


@pytest.mark.parametrize(("keep", "group"), [("none", 4096), ("first", 4096), ("none", 1), ("first", 1)])
def test_equals_brute_force(spark, keep, group):
    rows = fixture(11)
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = ss.deduplicate(docs, "cut", length=40, keep=keep, group=group).collect()
    assert all(r.kept == "x" and hashlib.sha256(r.cut.kept).hexdigest() == r.cut.kept_sha256 for r in got)
    assert sorted(((r.doc_id, *r.cut[:4]) for r in got), key=repr) == brute(rows, 40, keep)


def test_odd_rows_at_full_length(spark):
    rows = [(r[0], r[1]) for r in ODD] + [(20, ODD[5][1][300:]), (21, "q" * 401)]
    got = ss.deduplicate(table(spark, [(i, t, "en", "s", 1) for i, t in rows]), "cut", with_text=False).collect()
    assert sorted(((r.doc_id, *r.cut[:4]) for r in got), key=repr) == brute(rows, ss.LENGTH, "none")
    assert ss.deduplicate(table(spark, []), "cut").collect() == []


def test_factors_against_definition():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    every = [(k, i, t[i : i + 6]) for k, t in enumerate(texts) for i in range(len(t) - 5)]
    for (early, late), (k, t) in zip(ss.factors(texts, 6), enumerate(texts)):
        for i in range(max(0, len(t) - 5)):
            s = t[i : i + 6]
            assert early[i] == any(x == s and (a, b) < (k, i) for a, b, x in every)
            assert late[i] == any(x == s and (a, b) > (k, i) for a, b, x in every)


def test_anchors_are_leftmost_least():
    h = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64) << np.uint64(32)
    for w in (1, 2, 7, 64):
        assert ss._leftmost_least(h, w).tolist() == [i + int(h[i : i + w].argmin()) for i in range(len(h) - w + 1)]


def test_query_hands_out_what_remains(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))  # 409 bytes, 411 with the spaces around it
    short = " ".join(f"w{i}" for i in range(60))  # 229 bytes: stays, though it repeats
    split = "é" * 200
    rows = [(1, f"a {passage} b"), (2, f"c {passage} d"), (3, f"e {short} f"), (4, f"g {short} h"), (5, None), (6, "alone"),
            (7, f"à{split}x"), (8, f"\u0169{split}y")]  # the second bytes of à and \u0169 differ, so only é go
    rows += [(9, f"À{passage[:399]}1"), (10, f"\u0500{passage[:399]}2")]  # bytes C3 80 and D4 80: the cut begins inside a character
    table(spark, [(i, t, "en", "s", 1) for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in ss.query(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(1, 9)] == ["ab", "cd", rows[2][1], rows[3][1], "", "alone", "àx", "\u0169y"]
    assert all(hashlib.sha256(got[i].text.encode()).hexdigest() == got[i].kept_sha256 for i in range(1, 9))
    assert [got[i].text for i in (9, 10)] == ["\ufffd1", "\ufffd2"]
    assert [got[9].kept_sha256, got[10].kept_sha256] == [hashlib.sha256(b).hexdigest() for b in (b"\xc31", b"\xd42")]
    assert sorted(((i, *r[1:5]) for i, r in got.items()), key=repr) == brute(rows, ss.LENGTH, "none")


def test_suffix_order_of_starts_against_definition():
    rng = random.Random(9)
    for letters in (b"ab", b"a", bytes(range(97, 117))):
        data = bytes(rng.choice(letters) for _ in range(600))
        for depth in (1, 13, 100, 250):
            starts = np.array(sorted(rng.sample(range(600 - depth + 1), 60)))
            rank = ss.order_to_depth(np.frombuffer(data, np.uint8), depth, starts)[starts]
            strings = [data[i : i + depth] for i in starts]
            place = {x: i for i, x in enumerate(sorted(set(strings)))}
            assert np.unique(rank, return_inverse=True)[1].tolist() == [place[x] for x in strings]
