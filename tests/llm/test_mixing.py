from __future__ import annotations

from gleaner.llm import mixing

from .helpers import ODD, as_rows, table


def corpus():
    rows = []
    for i in range(900):
        lang, source = ("en", "web") if i % 3 else ("fr", "web" if i % 2 else "books")
        rows.append((i, "word " * (5 + i % 7) + ("@" if i % 5 == 0 else ""), lang, source, 1))
    return rows


def test_margins_reach_the_targets_and_the_budget_holds(spark):
    docs = table(spark, corpus())
    measured = mixing.mix(docs, "mix").select("mix.*")
    table_ = mixing.cells(measured)
    targets = mixing.default_targets(table_)
    raked = mixing.rake(table_, targets, sweeps=12)
    total = sum(r.t for r in raked.collect())
    for axis in mixing.AXES:
        want = {r[axis]: r.share for r in targets[axis].collect()}
        got = {r[axis]: r.m / total for r in mixing.margins(raked, axis, "w").collect()}
        assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
    rows = measured.collect()
    expected = sum(r.prob * r.n_tokens for r in rows)
    assert abs(expected - mixing.BUDGET * total) < 0.01 * total
    assert all(0 <= r.prob <= 1 for r in rows)
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert abs(kept - expected) < 0.1 * total


def test_given_targets_and_topics(spark):
    docs = table(spark, corpus())
    shares = lambda axis, d: spark.createDataFrame(list(d.items()), f"{axis} string, share double")
    targets = {"source": shares("source", {"web": 0.5, "books": 0.5}), "lang": shares("lang", {"fr": 0.8, "en": 0.2}), "topic": shares("topic", {"x": 1.0})}
    rows = mixing.mix(docs, "mix", topic="n", targets=targets, budget=0.3).select("mix.*").collect()
    weight = lambda **k: sum(r.weight * r.n_tokens for r in rows if all(r[a] == b for a, b in k.items()))
    assert abs(weight(lang="fr") / weight() - 0.8) < 0.01 and abs(weight(source="books") / weight() - 0.5) < 0.01


def test_odd_rows(spark):
    df = table(spark, ODD)
    got = mixing.mix(df, "mix").collect()
    assert len(got) == len(ODD) and all(r.kept == "x" and 0 <= r.mix.prob <= 1 for r in got)
    assert {r.mix.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {0}
    copies = [r.mix for r in got if r.doc_id == 7]
    assert copies[0] == copies[1]
    sampled = mixing.sample(df)
    assert sampled.columns == df.columns and set(as_rows(sampled)) <= set(as_rows(df))
    assert mixing.sample(table(spark, [])).collect() == []
