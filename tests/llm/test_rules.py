from __future__ import annotations

import random
import re

from gleaner.llm import rules

from .helpers import ODD, table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - rules.WINDOW + 1):
        places.setdefault(tuple(words[i : i + rules.WINDOW]), []).append(i)
    hit = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + rules.WINDOW)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("a b c dé e# \n \t".split(" ")) for _ in range(rng.randint(0, 60))), "en", "s", 1) for i in range(60)]
    rows += ODD
    got = rules.measure(table(spark, rows).drop("m"), keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words, r.m.base_failed) == brute(r.text)


def test_odd_rows_and_empty_table(spark):
    got = rules.judge(table(spark, ODD).drop("m", "kept"), keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all(r.kept is not None for r in got)
    assert [r.kept for r in got if r.doc_id in (2, 3, 4, 5)] == [False] * 4
    assert rules.judge(table(spark, []).drop("m", "kept")).collect() == []


def test_fences_follow_the_source(spark):
    """A rate that is ordinary in one source is an outlier in another."""
    plain = "one two three four five six seven eight nine ten eleven twelve"
    marked = plain.replace(" ", "# ")
    rows = [(i, f"{plain} {i}", "en", "prose", 1) for i in range(1200)] + [(2000 + i, f"{marked} {i}", "en", "code", 1) for i in range(1200)]
    rows += [(1, f"{marked} x", "en", "prose", 1), (3999, f"{marked} y", "en", "code", 1)]
    kept = {(r.doc_id, r.source): r.k for r in rules.judge(table(spark, rows).drop("m", "kept"), keep=["doc_id", "source"]).withColumnRenamed("kept", "k").where("m.n_symbols > 0").collect()}
    assert kept[3999, "code"] and not kept[1, "prose"] and sum(kept.values()) == len(kept) - 1


def test_sketch_bounds(spark):
    b, lo, hi = rules.bucket_of("v"), rules.lowest("b"), rules.highest("b")
    df = spark.range(70000).selectExpr("id AS v").selectExpr("v", f"{b} AS b").selectExpr("v", "b", f"{lo} AS lo", f"{hi} AS hi")
    assert df.where("NOT (lo <= v AND v <= hi AND hi - lo <= v / 8)").count() == 0
    merged = rules.sketch(rules.measure(table(spark, ODD).drop("m")), "m", "lang", "source").groupBy("rate").sum("n").collect()
    assert {r[1] for r in merged} == {len(ODD)}
