"""Licence scan with a positional index of rare words.

The licence notices below are the templates. A *postings* table maps each of their words to
(template, position). Which words are rare is learned from the corpus: the document
frequency of every template word, counted over all documents, gives its IDF. A template is
looked up by its ``TOP`` words of highest IDF. For a file the scan intersects the postings of
all these words by relative position (place in the file minus place in the template): hits of
one template with one offset agree. A template whose agreeing words reach a share of its IDF
weight, and whose mandatory key phrases stand in the text, gives its label. Templates don't
compete for places in the lookup, so a file may hold any number of notices.

All of it is array work inside the row, native from end to end: texts don't move and no key
can be hot. The only exchange counts document frequencies, one row per template word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.common import free_name
from gleaner.sources.tables import read_table

# Fixed values of the contract: phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of public licences as (label, text, key phrases that must all stand in the text).
TEMPLATES = (
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the License", ("except in compliance with the license",)),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License",
     ("redistribute it and or modify", "general public license")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
     ("with or without fee is hereby granted",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
)

#: Rarest words of a template that are looked up; least share of their weight that must agree.
TOP = 12
SHARE = 0.6
#: A licence word is looked up only if it is in less than this share of all documents.
COMMON = 0.2

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _split(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in _split(text)})


def normal(text: Column) -> Column:
    """Words of the contract joined by blanks, one blank at either end; empty for no words."""
    body = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _NOT_WORD, " ")
    return F.concat(F.lit(" "), F.btrim(body), F.lit(" "))


def words_of(normalized: Column) -> Column:
    return F.array_remove(F.split(normalized, " "), "")


def _phrase_places(w: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.transform(w, lambda x, i: F.when(
        (x == parts[0]) & _all([F.coalesce(F.get(w, i + k) == p, F.lit(False)) for k, p in enumerate(parts[1:], 1)]), i,
    ))
    return F.filter(at, lambda x: x.isNotNull())


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def document_frequency(docs: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, over all documents, and their number."""
    words = F.array_distinct(F.filter(words_of(normal(F.col(f"`{text}`"))), lambda x: x.isin(VOCABULARY)))
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), words)).alias("w")).groupBy("w").count()
    found = {w: n for w, n in seen.collect()}  # at most one row per template word
    return found, found.pop("", 0)


def idf_of(frequency: dict[str, int], n_docs: int) -> dict[str, float]:
    return {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 0.5)) for w in VOCABULARY}


def scan(docs: DataFrame, result: str, text: str = "text", idf: dict[str, float] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with a struct ``result``: n_words, starts, base_labels, labels, score.

    ``starts`` are the places of the base phrases (word ordinals), ``labels`` base labels and
    those of the templates, ``score`` the best share of a template's weight that agrees in one
    place (0 without any). Null, empty and wordless texts have no words and no labels.
    Repeated rows get equal results; columns of other names pass through untouched.
    """
    if idf is None:
        idf = idf_of(*document_frequency(docs, text))
    kept = docs.columns if keep is None else keep
    norm = free_name(docs, "norm_in")
    bound = math.log(1 / COMMON)
    rare = [w for w in VOCABULARY if idf[w] > bound]
    # Words in every document still need places where a template has few others, so the rarest of each template stay.
    for _, notice, _ in TEMPLATES:
        rare += sorted(set(_split(notice)), key=lambda w: (-idf[w], w))[:2]
    rare = sorted(set(rare))
    postings: dict[str, list[tuple[int, int]]] = {}
    total = []
    for t, (_, notice, _) in enumerate(TEMPLATES):
        own = [(q, w) for q, w in enumerate(_split(notice)) if w in set(rare)]
        best = set(sorted({w for _, w in own}, key=lambda w: (-idf[w], w))[:TOP])
        own = [(q, w) for q, w in own if w in best]
        total.append(sum(idf[w] for _, w in own))
        for q, w in own:
            postings.setdefault(w, []).append((t, q))
    rare = sorted(postings)
    weight = F.create_map(*[x for w in rare for x in (F.lit(w), F.lit(float(idf[w])))])
    table = F.create_map(*[
        x for w in rare for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in postings[w]]))
    ])

    def one(normalized: Column) -> Column:
        phrases = list(PHRASES)
        starts = lambda w: F.array_sort(F.concat(*[_phrase_places(w, p) for p in phrases]))
        base = F.array_compact(F.array(*[F.when(F.contains(normalized, F.lit(f" {p} ")), F.lit(PHRASES[p])) for p in phrases]))
        scored = let(words_of(normalized), lambda w: F.struct(
            F.when(F.size(base) > 0, starts(w)).otherwise(F.array().cast("array<int>")).alias("starts"), _templates(w, normalized).alias("found"),
        ))
        return F.struct(base.alias("base"), scored.alias("s"))

    def _templates(w: Column, normalized: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("p"))), lambda h: h["w"].isin(rare))
        return let(hits, lambda h: F.when(F.size(h) == 0, F.array().cast("array<struct<t:int,share:double>>")).otherwise(
            _agree(h, normalized),
        ))

    def _agree(h: Column, normalized: Column) -> Column:
        pairs = F.flatten(F.transform(h, lambda x: F.transform(
            F.try_element_at(table, x["w"]),
            lambda y: F.struct(y["t"].alias("t"), (x["p"] - y["q"]).alias("o"), F.try_element_at(weight, x["w"]).alias("v")),
        )))
        # Sorted by template and offset, agreeing hits are neighbours: one fold sums them and keeps the best of each template.
        start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("o"), F.lit(0.0).alias("v"), F.array().cast("array<struct<t:int,v:double>>").alias("best"))

        def step(acc: Column, x: Column) -> Column:
            same = (acc["t"] == x["t"]) & (acc["o"] == x["o"])
            v = F.when(same, acc["v"]).otherwise(F.lit(0.0)) + x["v"]
            head = F.get(acc["best"], F.size(acc["best"]) - 1)
            fresh = F.struct(x["t"].alias("t"), v.alias("v"))
            best = F.when((F.size(acc["best"]) > 0) & (head["t"] == x["t"]), F.when(
                v > head["v"], F.concat(F.slice(acc["best"], 1, F.greatest(F.size(acc["best"]) - 1, F.lit(0))), F.array(fresh)),
            ).otherwise(acc["best"])).otherwise(F.concat(acc["best"], F.array(fresh)))
            return F.struct(x["t"].alias("t"), x["o"].alias("o"), v.alias("v"), best.alias("best"))

        best = F.aggregate(F.array_sort(pairs), start, step, lambda acc: acc["best"])
        totals = F.array(*[F.lit(max(x, 1e-9)) for x in total])
        phrases = F.array(*[F.array(*[F.lit(f" {p} ") for p in keys]) for _, _, keys in TEMPLATES])
        shares = F.transform(best, lambda b: F.struct(b["t"].alias("t"), (b["v"] / F.get(totals, b["t"])).alias("share")))
        return F.filter(shares, lambda b: (b["share"] >= SHARE) & F.forall(F.get(phrases, b["t"]), lambda p: F.contains(normalized, p)))

    # The normal form is a column of its own, so that it is computed once for all that follows.
    body = docs.select(*[F.col(f"`{c}`") for c in kept], F.array(normal(F.col(f"`{text}`"))).alias(norm))
    labels = F.array(*[F.lit(t[0]) for t in TEMPLATES])
    answer = F.get(F.transform(F.col(norm), lambda n: let(one(n), lambda r: F.struct(
        F.when(F.btrim(n) == "", F.lit(0)).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        r["s"]["starts"].alias("starts"), F.array_sort(F.array_distinct(r["base"])).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(r["base"], F.transform(r["s"]["found"], lambda x: F.get(labels, x["t"]))))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(r["s"]["found"], lambda x: x["share"])), F.lit(0.0))).alias("score"),
    ))), F.lit(0))
    return body.select(*[F.col(f"`{c}`") for c in kept], answer.alias(result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    r = F.col("found")
    return scan(docs, "found", keep=["doc_id"]).select(
        "doc_id", r["n_words"].alias("n_words"), F.size(r["starts"]).cast("long").alias("n_base"),
        F.array_min(r["starts"]).cast("long").alias("first_word"), F.array_max(r["starts"]).cast("long").alias("last_word"),
        F.array_join(r["base_labels"], ",").alias("base_labels"), F.array_join(r["labels"], ",").alias("labels"),
        r["score"].alias("score"),
    )
