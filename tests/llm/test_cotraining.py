from __future__ import annotations

from gleaner.llm import cotraining as ct

from .helpers import ODD, table


def corpus(n=240):
    rows = []
    for i in range(n):
        good = i % 2
        text = f"clean calm prose number {i} about things of the world" if good else f"awful vile words {i} *** $$$ about things"
        rows.append((i, text, "en", "fine" if good else "spam", len(text)))
    return rows


def test_separates_both_views_and_takes_odd_rows(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (None, 1)], "doc_id long, good int")
    docs = table(spark, rows + [(1000 + k, *r[1:]) for k, r in enumerate(ODD)])
    model = ct.fit(docs, labels)
    got = ct.score(docs, model, "q").collect()
    assert len(got) == len(rows) + len(ODD) and all(r.kept == "x" and 0 <= r.q.score <= 1 for r in got)
    unseen = [r for r in got if 120 <= r.doc_id < 240]
    assert all(r.q.kept == bool(r.doc_id % 2) for r in unseen)
    assert all((r.q.meta_score > 0.5) == bool(r.doc_id % 2) for r in unseen)
    assert ct.score(table(spark, []), model, "q").collect() == []


def test_without_labels_nothing_is_rejected(spark):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, good int")
    assert all(r.q.kept for r in ct.score(docs, ct.fit(docs, labels), "q").collect())


def test_one_view_teaches_the_other():
    """Words that no labelled row has get a weight from what the metadata view is sure of."""
    import numpy as np

    known = [(["a"], ["s:x"], 1.0), (["b"], ["s:y"], 0.0)] * 200
    pool = [(["new"], ["s:x"], np.nan), (["other"], ["s:y"], np.nan)] * 200
    code = {"a": 1, "b": 2, "new": 3, "other": 4}
    rows = known + pool
    held = np.array([i % 8 < 2 for i in range(len(rows))])
    args = ([np.array([code[w] for w in r[0]]) for r in rows], np.zeros((len(rows), ct.N_SURFACE)), [r[1] for r in rows],
            np.array([r[2] for r in rows]), held)
    alone, taught = ct._cotrain(*args, rounds=0), ct._cotrain(*args, rounds=3)
    weight = lambda m, w: m.text.weights[m.columns[code[w]]]
    assert abs(weight(alone, "new")) < 1e-6
    assert weight(taught, "new") > 0.1 > -0.1 > weight(taught, "other")


def test_every_unlabelled_row_takes_part(spark, monkeypatch):
    """Sums over the pool in Spark equal those in memory, copies weigh as much as they are many, and no row is left out."""
    import numpy as np

    taken = {}
    plain, cells = ct.Dealt.slopes, ct.Dealt.cells

    def slopes(self, model, columns, given):
        taken["args"], taken["got"] = (model, columns, given), plain(self, model, columns, given)
        return taken["got"]

    def counted(self):
        taken["rows"] = self.rows.collect()
        return cells(self)

    monkeypatch.setattr(ct.Dealt, "slopes", slopes)
    monkeypatch.setattr(ct.Dealt, "cells", counted)
    rows = corpus(200)
    for i in range(200, 7000):
        good = i % 2
        body = f"{'fresh' if good else 'stale'} things {i % 50}" if i % 3 else "fresh copy of things"
        rows.append((i, body, "en", "fine" if good or not i % 3 else "spam", 40))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, good int")
    model = ct.fit(table(spark, rows).repartition(4), labels, rounds=1)
    assert sum(r.copies_in for r in taken["rows"]) == 6800 and len(taken["rows"]) < 300
    every = [r for r in taken["rows"] for _ in range(r.copies_in)]
    memory = ct.Held([np.array(r.words) for r in every], np.array([r.surface for r in every]), [tuple(r.meta_in) for r in every])
    assert np.allclose(taken["got"], memory.slopes(*taken["args"])) and taken["got"][1].any()
    weight = lambda w: model.text.weights[model.columns[ct.word_codes(w)[0]]]
    assert weight(b"fresh") > 0.01  # a word of no labelled row
