from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gleaner.llm import crosstok
from tests.llm.helpers import ODD, table

TEXTS = [
    "Hello world", " two  spaces\n\n  and \t tabs ", "no-space" * 50, "", None, "\n", "   ", "<|endoftext|> <s> </s> <unk> <0x41>", "white ▁ mark",
    "é🙂 naïve 漢字かな交じり文 שלום عربي", "don't  I'll we've 12345 3.14159", "a b c　d   e", "\x00\x1c \x1f x\x85 y", "x" * 3000,
    "😀" * 200 + " end", "if (a) {\n    return b;\n}\r\n", "Hello world", "the the the the the the the the the", "ﬁ ligature ½ ｆｕｌｌ", "� a",
]


@pytest.fixture(scope="module")
def tokenizers():
    return crosstok.Tokenizers(f"{crosstok.FOLDER}/{crosstok.FILE_A}", f"{crosstok.FOLDER}/{crosstok.FILE_B}")


def brute(tokenizers, docs):
    """Whole texts through the tokenizers; every link in a plain dictionary."""
    made, holders = [], Counter()
    for i, text in docs:
        whole, links, groups = " " + (text or ""), Counter(), []
        a = tokenizers.a.encode(whole, add_special_tokens=False).ids
        b = tokenizers.b.encode(text or "")
        raw = whole.encode()
        spelled_a = [tokenizers.bytes_a[x] for x in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if tokenizers.b.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [tokenizers.b.id_to_piece(x)]]
        if not text or b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            made.append((i, 0, 0, 0, "", Counter()))
            continue
        ends_a, ends_b = list(np.cumsum([len(x) for x in spelled_a])), list(np.cumsum([len(x) for x in spelled_b]))
        p = q = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            u, v = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            inside_a, inside_b = a[p:u], b[q:v]
            p, q = u, v
            groups.append(f"{','.join(map(str, inside_a))}|{','.join(map(str, inside_b))}")
            links.update((x, y) for x in inside_a for y in inside_b)
        holders.update(links.keys())
        made.append((i, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    rows = [
        (i, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if holders[p] == best[p[0]]),
         sum(n * holders[p] for p, n in links.items()), digest)
        for i, n_a, n_b, n_groups, digest, links in made
    ]
    return sorted(rows, key=repr), holders


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_to_whole_texts_and_plain_counts(spark, tokenizers):
    rng = random.Random(5)
    alphabet = ["the", "then", " ", "  ", "\n", "é", "x9", "ing", ".", "'s", "🙂", " ", "\t", "A", "<s>", "ab-c", "\x1d", "\x85"]
    docs = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)] + [(7, t) for t in TEXTS[:3]]
    docs += [(100 + k, "".join(rng.choices(alphabet, k=rng.randint(1, 80)))) for k in range(150)]
    want, holders = brute(tokenizers, docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for parts, span in ((1, 16), (3, 32), (2, crosstok.BLOCK_DOCS)):
        index = crosstok.build_index(df.repartition(parts), block_docs=span)
        assert result(crosstok.scores(index, span)) == want
    found = {(r.a, r.b): r.n_docs for r in crosstok.pairs(index).collect()}
    assert found == dict(holders)
    assert sum(r.n_links for r in crosstok.pairs(index).collect()) == sum(r[4] for r in want)


def test_given_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, _ = brute(tokenizers, [tuple(r) for r in docs.collect()])
    assert result(crosstok.query(spark, "/root/testdata/sf0.001")) == want


def test_odd_rows_and_empty_table(spark, tokenizers):
    docs = table(spark, ODD)
    assert result(crosstok.scores(crosstok.build_index(docs))) == brute(tokenizers, [(r[0], r[1]) for r in ODD])[0]
    assert result(crosstok.scores(crosstok.build_index(docs.limit(0)))) == []
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert result(crosstok.scores(crosstok.build_index(broken))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_in_slices_and_a_small_memory(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(crosstok, "_PIECE", 500)
    text = "".join(f"word{i % 991}  \n x{i}" for i in range(3_000))
    assert "".join(crosstok.slices(text, 500)) == text
    assert len(list(crosstok.slices(text, 500))) > 50
    one = crosstok.Chunks(tokenizers)
    numbers = np.concatenate([one.numbers(p) for p in crosstok.slices(" " + text, 500)])
    assert "".join(np.array(list(one.number), object)[numbers]) == " " + text
    docs = [(k, t + " " + t) for k, t in enumerate(TEXTS) if t] + [(50, text)]
    monkeypatch.setattr(crosstok, "MEMORY", 3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(crosstok.scores(crosstok.build_index(df, block_postings=200))) == brute(tokenizers, docs)[0]


def test_bitmaps_round_trip_and_merge():
    rng = random.Random(2)
    for span in (16, 64, 1 << 16):
        parts, want = [], defaultdict(set)
        for k in range(3):
            sets = {key: rng.sample(range(k, span, 3), rng.choice([0, 1, span // 30, span // 4])) for key in rng.sample(range(40), 12)}
            sets = {key: sorted(v) for key, v in sorted(sets.items()) if v}
            keys = np.array(list(sets), np.int64)
            slots = np.repeat(np.arange(len(keys)), [len(v) for v in sets.values()])
            parts.append((keys, crosstok.Bitmaps.make(slots, np.concatenate([np.array(v) for v in sets.values()]), len(keys), span)))
            for key, v in sets.items():
                want[key] |= set(v)
        keys, merged = crosstok.or_merge(parts)
        slots, ordinals = merged.members()
        assert list(keys) == sorted(want)
        assert {int(k): set(map(int, ordinals[slots == s])) for s, k in enumerate(keys)} == want
        assert list(merged.popcount()) == [len(want[k]) for k in sorted(want)]
        again = crosstok.Bitmaps.from_arrow(merged.to_arrow()[1:], span)
        assert list(again.popcount()) == [len(want[k]) for k in sorted(want)][1:]
        assert merged.data.nbytes <= sum(min(2 * len(v), span // 8) for v in want.values())


def test_blocks_are_bounded(spark):
    with pytest.raises(ValueError):
        crosstok.build_index(table(spark, ODD), block_docs=100)
