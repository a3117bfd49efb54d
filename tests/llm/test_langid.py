from __future__ import annotations

import os

import pytest

from gleaner.llm import langid

from .helpers import ODD, as_rows, table

EN = "the cat and the dog with this house that was there from the morning when they went out"
FR = "le chat et la maison avec les enfants dans une rue pour aller vers le marché quand ils sont partis"
RU = "кошка и собака в доме на улице вместе с детьми города когда они ушли утром"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, l, "s", 1) for i in range(20) for t, l in ((EN, "en"), (FR, "fr"), (RU, "ru"), ("x", None), (None, "en"))]
    return langid.fit(table(spark, rows))


def test_odd_rows(spark, model):
    got = langid.identify(table(spark, ODD), model, "language").collect()
    assert len(got) == len(ODD)
    assert all(r.kept == "x" and 0 <= r.language.score <= 1 for r in got)
    for r in got:
        assert (r.language.lang == "und") == (r.doc_id in (2, 3, 4, 5)), r
    copies = [r.language for r in got if r.doc_id == 7]
    assert copies[0] == copies[1]
    assert langid.identify(table(spark, []), model, "language").collect() == []


def test_spans_of_mixed_text(spark, model):
    text = f"{EN} {FR} 12 {RU}"
    row = langid.identify(table(spark, [(1, text, None, None, 0)]), model, "r").first().r
    n = [len(t.split()) for t in (EN, FR, RU)]
    assert [(s.start, s.end, s.lang) for s in row.spans] == [
        (0, n[0], "en"), (n[0], n[0] + n[1], "fr"), (n[0] + n[1], sum(n), "ru")]
    assert row.n_words == sum(n)


def test_viterbi_equals_plain_program(model):
    import numpy as np

    texts = [t.encode() for t in (EN, FR + " " + EN, RU, "", "a")]
    words = langid.Words(texts)
    scores, labels = model.word_scores(words), model.label(words, 8.0)
    for a, b in zip(words.first[:-1], words.first[1:]):
        best, back = None, []
        for t in range(a, b):
            if best is None:
                best = scores[t].astype(float)
                continue
            change = best.max() - 8.0 > best
            back.append(np.where(change, best.argmax(), np.arange(len(best))))
            best = np.where(change, best.max() - 8.0, best) + scores[t]
        if best is None:
            continue
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        assert labels[a:b].tolist() == path[::-1]


def test_nothing_learned(spark):
    model = langid.fit(table(spark, [(1, "abc", None, None, 1)]))
    row = langid.identify(table(spark, ODD[:1]), model, "r").first().r
    assert (row.lang, row.score) == ("und", 0.0)


def test_stage_keeps_columns_and_good_rows(spark):
    rows = [(i, t, l, "s", 1) for i in range(40) for t, l in ((EN, "en"), (FR, "fr"))] + [(99, "1 2", "en", "s", 1), (98, None, "en", "s", 1)]
    df = table(spark, rows)
    assert as_rows(langid.drop_unidentified(df)) == as_rows(df.where("doc_id < 90"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables not present")
def test_held_out_accuracy(spark):
    found = langid.query(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
