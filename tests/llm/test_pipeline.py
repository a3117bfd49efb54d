from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

from .helpers import ODD, table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


def test_stages_take_odd_and_empty_tables(spark):
    """Each stage by itself on rows with nulls, copies and clashing columns, and on none."""
    for _, stage in cp.STAGES:
        for rows in (ODD, []):
            df = table(spark, rows)
            out = stage(spark, df, FOLDER)
            assert out.columns == df.columns
            assert out.count() <= len(rows)


def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = cp.run(spark, FOLDER)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 0 < len(ids) == len(set(ids)) < docs.count()
    assert out.join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id").where("lang <> l").count() == 0


def test_near_duplicates_are_told_by_five_words_and_eighty_percent(spark):
    """A footer that leaves 0.82 is a near-duplicate; scattered edits that leave less than 0.8 are none."""
    rng = random.Random(4)
    word = lambda: f"v{rng.randint(0, 10**9)}"
    rows, want = [], []
    for f in range(8):
        base = [word() for _ in range(400)]
        edited = [word() if i % 44 == 20 and i < 400 else w for i, w in enumerate(base)]
        other = [word() for _ in range(400)]
        footer = other + [word() for _ in range(87)]
        rows += [(4 * f + i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, edited, other, footer))]
        want += [4 * f, 4 * f + 1, 4 * f + 2]
    sets = {r[0]: {tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.78 < alike(0, 1) < 0.8 < alike(2, 3) < 0.825
    got = cp.drop_near_duplicates(spark, table(spark, rows), FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_benchmark_stage_equals_a_plain_loop(spark):
    """Kept documents of the given table, window by window."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    windows = set()
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(item.text)
        m = min(13, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
    lengths, want = {len(w) for w in windows}, []
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for r in docs.collect():
        w, hit = words(r.text), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
        if not hit or 20 * len(hit) < len(w):
            want.append(r.doc_id)
    got = [r.doc_id for r in cp.drop_contaminated(spark, docs, FOLDER).collect()]
    assert sorted(got) == sorted(want) and len(want) < docs.count()


def test_masking_stage_keeps_rows_and_leaves_nothing_to_mask(spark):
    """All documents stay, texts without personal data as they were, and no e-mail address is left."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in cp.mask_personal_data(spark, docs, FOLDER).collect()}
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert set(after) == set(before) and not any(mail.search(t or "") for t in after.values())
    plain = [i for i, t in before.items() if t and not re.search(r"[@+0-9]", t)]
    assert plain and all(after[i] == before[i] for i in plain)
    assert any(mail.search(t or "") for t in before.values())
