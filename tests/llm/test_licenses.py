from __future__ import annotations

import random
import re

from gleaner.llm import licenses as lic

from .helpers import ODD, table


def plain_words(text):
    text = (text or "").translate(str.maketrans(lic._UPPER, lic._LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text):
    words = plain_words(text)
    starts, labels = [], set()
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), sorted(starts), sorted(labels)


def test_base_equals_brute_force(spark):
    rng = random.Random(6)
    parts = ["MIT", "license", "License,", "apache", "general", "public", "GNU", "über", "x", "2.0", "K", "--", "mit\nlicense"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "en", "s", 1) for i in range(150)] + ODD
    got = lic.scan(table(spark, rows).drop("found"), "found", keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.found.n_words, r.found.starts, r.found.base_labels) == brute(r.text), r.text
        assert set(r.found.base_labels) <= set(r.found.labels) and 0 <= r.found.score <= 1


def test_templates_are_found_whole_and_only_there(spark):
    filler = "some words about nothing in particular that stand around a notice of a file"
    rows = [(i, f"{filler} {text} {filler}", "en", "s", 1) for i, (_, text, _) in enumerate(lic.TEMPLATES)]
    rows += [(100 + i, f"{filler} {i}", "en", "s", 1) for i in range(200)]
    rows += [(400, "version 2 of the mit people and a license for the public", "en", "s", 1), (401, "Licensed under CC words BY and NC 4.0", "en", "s", 1)]
    got = {r.doc_id: r.found for r in lic.scan(table(spark, rows).drop("found"), "found", keep=["doc_id"]).collect()}
    for i, (label, _, _) in enumerate(lic.TEMPLATES):
        assert label in got[i].labels and got[i].score > 0.9, (label, got[i])
    assert all(not got[i].labels and got[i].score == 0 for i in got if i >= 100)
    assert lic.scan(table(spark, []).drop("found"), "found").collect() == []


def test_several_notices_in_one_file(spark):
    """Notices don't crowd each other out, nor do other rare licence words before them."""
    notice = lambda *labels: [text for label, text, _ in lic.TEMPLATES if label in labels]
    wanted = [
        {"mit", "bsd"}, {"bsd", "isc"}, {"mit", "bsd", "isc"}, {"mit", "apache-2.0"}, {label for label, _, _ in lic.TEMPLATES},
    ]
    rows = [(i, " and some words between ".join(notice(*labels)), "en", "s", 1) for i, labels in enumerate(wanted)]
    stray = " ".join(reversed(lic.VOCABULARY))
    rows += [(50 + t, f"{stray} here {text}", "en", "s", 1) for t, (_, text, _) in enumerate(lic.TEMPLATES)]
    rows += [(100 + i, f"words about nothing in particular {i}", "en", "s", 1) for i in range(200)]
    got = {r.doc_id: r.found for r in lic.scan(table(spark, rows).drop("found"), "found", keep=["doc_id"]).collect()}
    for i, labels in enumerate(wanted):
        assert labels <= set(got[i].labels), (labels, got[i])
    for t, (label, _, _) in enumerate(lic.TEMPLATES):
        assert label in got[50 + t].labels, (label, got[50 + t])
    assert all(not got[i].labels for i in got if i >= 100)
