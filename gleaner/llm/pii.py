"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

*Generators* are patterns that propose spans, overlapping or not: the four base kinds, whose
validated matches are always redacted, and looser forms (written-out addresses, national
phone numbers, long mixed tokens such as access keys). *Boosted trees* judge the loose
proposals by their format (length, digits, separators, first character) and context (cue
words before, neighbouring characters). They learn from the corpus itself: validators that
the features can't see (check digits, number ranges, assignment of a quoted value) label
proposals as true or false. *Thresholds* per kind are calibrated on another fold to the
wanted precision; a kind without evidence selects nothing.

All features are small integers, so all labelled proposals of all documents sum up to a
table of at most ``CELLS`` feature cells, an ordinary aggregation. The trees are fitted on
that table and become an SQL expression: scanning is native, inside the row, without an
exchange. Positions count code points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.common import free_name
from gleaner.sources.tables import read_table

# Fixed values of the contract: the base kinds in order, and their patterns. Matches are those of the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                 phone \+[0-9][\x20().0-9-]+[0-9]
# Look-behinds (or the end of the match before) and possessive loops keep the search linear on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser generators: name -> (kind, pattern).
LOOSE = {
    "spelled": ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\(\[\{]at[\)\]\}] ?[a-z0-9-]++(?: ?(?:\.|[\(\[\{]dot[\)\]\}]) ?[a-z0-9-]++)++"),
    "national": ("phone", r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z.-])"),
    "token": ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}"),
}
KINDS = (*BASE, "secret")
GENERATORS = (*BASE, *LOOSE)

# Cue words that may stand before a span, by class.
CUES = (
    ("phone", r"\b(?:phone|tel|telephone|mobile|cell|call|fax|contact|whatsapp)\b"),
    ("mail", r"\b(?:e-?mail|mail|mailto|write to)\b"),
    ("net", r"\b(?:ip|host|server|address|addr|ping)\b"),
    ("card", r"\b(?:card|visa|mastercard|amex|credit|debit|account|iban)\b"),
    ("secret", r"\b(?:token|key|secret|password|passwd|pwd|bearer|credential|auth)\b"),
    ("other", r"\b(?:version|order|id|isbn|issn|doi|sku|no|page|figure|section|commit|sha|hash|checksum)\b"),
)
BEFORE = 24  # code points of context

FEATURES = {"generator": len(GENERATORS), "length": 6, "digits": 5, "separators": 3, "first": 4, "hex": 2, "cue": len(CUES) + 1, "previous": 4}
CELLS = math.prod(FEATURES.values())

TREES, DEPTH, RATE = 24, 3, 0.3
PRECISION = 0.9
#: Labelled proposals of the calibration fold that a kind's threshold rests on, at least.
EVIDENCE = 20

SPAN = "array<struct<start:int,rank:int,end:int>>"


def _starts(lengths: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an array of lengths: sums of blocks, then sums within a block."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    return let(lengths, lambda ls: let(
        F.aggregate(
            F.transform(F.sequence(F.lit(0), F.floor(F.size(ls) / block).cast("int")), lambda b: add(F.slice(ls, (b * block + 1).cast("int"), F.lit(block)))),
            F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
        ),
        lambda sums: F.transform(ls, lambda _, i: F.get(sums, F.floor(i / block).cast("int")) + add(
            F.slice(ls, (F.floor(i / block) * block + 1).cast("int"), (i % block).cast("int"))
        )),
    ))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, m>>, end exclusive, in code points.

    The pieces between the matches (a split by the same pattern) give the places.
    """
    none = F.array().cast("array<struct<start:int,end:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(
        F.struct(found.alias("m"), F.split(text, pattern, -1).alias("gap")),
        lambda f: let(
            _starts(F.transform(f["m"], lambda x, i: F.length(F.get(f["gap"], i)) + F.length(x))),
            lambda begin: F.transform(f["m"], lambda x, i: F.struct(
                (F.get(begin, i) + F.length(F.get(f["gap"], i))).alias("start"),
                (F.get(begin, i) + F.length(F.get(f["gap"], i)) + F.length(x)).alias("end"), x.alias("m"),
            )),
        ),
    )).otherwise(none)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Check digit test of a string of ASCII digits."""
    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        return m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?){3}$")
    if kind == "card":
        return let(digits_of(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


def _interesting(t: Column) -> Column:
    """Cheap test before any generator runs: all need a digit, an at sign or a bracketed one."""
    return t.rlike("[0-9@]|(?i)[\\(\\[\\{]at[\\)\\]\\}]")


def base_spans(t: Column) -> Column:
    """Validated base spans: array<struct<start, rank, end>>, by start, then kind."""
    def of_kind(rank: int, kind: str) -> Column:
        return F.transform(F.filter(matches(t, BASE[kind]), lambda x: valid(kind, x["m"])), lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))

    each = [of_kind(rank, kind) for rank, kind in enumerate(BASE)]
    return F.when(_interesting(t), F.array_sort(F.concat(*each))).otherwise(F.array().cast(SPAN))


def _clip(x: Column, most: int) -> Column:
    return F.least(x, F.lit(most)).cast("int")


def describe(t: Column, x: Column, generator: int) -> Column:
    """Feature struct of one proposal ``x`` (start, end, m)."""
    m, n = x["m"], F.length(x["m"])
    digits = F.length(digits_of(m))
    previous = F.substring(t, x["start"], F.lit(1))
    before = F.lower(F.substring(t, F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, F.least(x["start"], F.lit(BEFORE))))
    cue = F.lit(0)
    for i, (_, words) in reversed(list(enumerate(CUES, 1))):
        cue = F.when(before.rlike(words), F.lit(i)).otherwise(cue)
    head = F.substring(m, 1, 1)
    return F.struct(
        F.lit(generator).alias("generator"), _clip(F.floor(n / 8), FEATURES["length"] - 1).alias("length"),
        _clip(F.floor(4 * digits / n), 4).alias("digits"),
        _clip(F.length(F.regexp_replace(m, "[^ ().-]", "")), 2).alias("separators"),
        F.when(head.rlike("[0-9]"), 0).when(head.rlike("[A-Za-z]"), 1).when(head == "+", 2).otherwise(3).alias("first"),
        m.rlike("^[0-9A-Fa-f]+$").cast("int").alias("hex"), cue.alias("cue"),
        F.when((x["start"] == 0) | previous.rlike(r"\s"), 0).when(previous.rlike("[\"'=:`]"), 1).when(previous.rlike("[0-9A-Za-z]"), 2)
        .otherwise(3).alias("previous"),
    )


def proposals(t: Column, base: Column) -> Column:
    """All proposals: array<struct<start, end, rank, label, f>>; label 1 true, 0 false, null unknown."""
    def inside(x: Column) -> Column:
        return F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))

    def label(name: str, x: Column) -> Column:
        if name in BASE:
            return valid(name, x["m"]).cast("int")
        if name == "national":  # the part of an international number after its country code, against parts of other numbers
            phone = F.exists(base, lambda b: (b["rank"] == 3) & (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
            return F.when(phone, 1).when(inside(x), 0)
        if name == "token":  # a quoted value that is assigned to a name
            lead = F.substring(t, F.greatest(x["start"] - 4, F.lit(0)) + 1, F.least(x["start"], F.lit(4)))
            return F.when(lead.rlike("[=:]\\s?[\"']$"), 1).when(lead.rlike("[A-Za-z,.;]\\s$"), 0)
        return F.lit(None).cast("int")

    def by(g: int, name: str) -> Column:
        kind, pattern = LOOSE[name] if name in LOOSE else (name, BASE[name])
        return F.transform(matches(t, pattern), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), label(name, x).alias("label"),
            describe(t, x, g).alias("f"),
        ))

    each = [by(g, name) for g, name in enumerate(GENERATORS)]
    shape = "array<struct<start:int,end:int,rank:int,label:int,f:struct<" + ",".join(f"{k}:int" for k in FEATURES) + ">>>"
    return F.when(_interesting(t), F.concat(*each)).otherwise(F.array().cast(shape))


@dataclass
class Trees:
    """Boosted trees over integer features, and a threshold per kind (None: select nothing)."""

    bias: float
    trees: list
    thresholds: dict[str, float | None]

    def sql(self, f: Column) -> Column:
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, cut, low, high = node
            return F.when(f[name] <= cut, walk(low)).otherwise(walk(high))

        out = F.lit(float(self.bias))
        for tree in self.trees:
            out = out + walk(tree)
        return out


def _boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[float, list, np.ndarray]:
    """Second-order gradient boosting on cells: ``positive`` of ``total`` proposals are true."""
    rate = (positive.sum() + 1) / (total.sum() + 2)
    bias = math.log(rate / (1 - rate))
    score, trees, names = np.full(len(total), bias), [], list(FEATURES)

    def grow(rows: np.ndarray, depth: int):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = None
        if depth:
            for j, name in enumerate(names):
                gs = np.bincount(x[rows, j], grad[rows], FEATURES[name]).cumsum()[:-1]
                hs = np.bincount(x[rows, j], hess[rows], FEATURES[name]).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                if len(gain) and gain.max() > 1e-6 and (best is None or gain.max() > best[0] + 1e-9):
                    best = gain.max(), j, int(gain.argmax())
        if best is None:
            value = RATE * g / (h + 1)
            score[rows] += value
            return float(value)
        _, j, cut = best
        left = x[rows, j] <= cut
        return names[j], cut, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)

    for _ in range(TREES if len(total) else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = positive - p * total, p * (1 - p) * total
        trees.append(grow(np.arange(len(total)), DEPTH))
    return bias, trees, score


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> Trees:
    """Learn from the proposals of all documents, summed to at most twice ``CELLS`` rows.

    Two thirds of the texts (by hash, so copies stay together) fit the trees, the rest
    calibrates: a kind's threshold is the lowest score from which on its labelled proposals
    reach ``precision``. A fold without proposals selects nothing beyond the base.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = F.filter(let(base_spans(F.col("t")), lambda b: proposals(F.col("t"), b)), lambda x: x["label"].isNotNull())
    rows = docs.select(t.alias("t")).where(_interesting(F.col("t")))
    rows = rows.select((F.pmod(F.xxhash64("t"), F.lit(3)) == 0).alias("held"), F.explode(found).alias("x"))
    cells = rows.groupBy("held", "x.rank", *[F.col(f"x.f.{k}").alias(k) for k in FEATURES]).agg(
        F.sum("x.label").alias("yes"), F.count("*").alias("n")
    ).orderBy("held", "rank", *FEATURES).collect()
    x = np.array([[r[k] for k in FEATURES] for r in cells], int).reshape(-1, len(FEATURES))
    held = np.array([r["held"] for r in cells], bool)
    rank, yes, n = (np.array([r[k] for r in cells], float) for k in ("rank", "yes", "n"))
    bias, trees, _ = _boost(x[~held], yes[~held], n[~held])
    score = np.full(len(n), bias)
    for tree in trees:
        score += np.array([_leaf(tree, row) for row in x])
    thresholds: dict[str, float | None] = {}
    for k, kind in enumerate(KINDS):
        mine = np.flatnonzero(held & (rank == k))
        order = mine[np.argsort(-score[mine], kind="stable")]
        good, seen = yes[order].cumsum(), n[order].cumsum()
        last = np.append(score[order][1:] != score[order][:-1], True)[: len(order)]
        ok = np.flatnonzero((good >= precision * seen) & (seen >= EVIDENCE) & last)
        thresholds[kind] = float(score[order][ok[-1]]) if len(ok) else None
    return Trees(bias, trees, thresholds)


def _leaf(node, row: np.ndarray) -> float:
    names = list(FEATURES)
    while isinstance(node, tuple):
        name, cut, low, high = node
        node = low if row[names.index(name)] <= cut else high
    return node


def scan(docs: DataFrame, trees: Trees, result: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with a struct ``result``: base and spans, arrays of struct<start, rank, end>.

    ``rank`` numbers ``KINDS``. ``spans`` holds the base spans and the selected proposals that
    no base span contains, by start, then kind, then end; they may overlap. A null or empty
    text has none. Repeated rows get equal results.
    """
    kept = docs.columns if keep is None else keep
    body = free_name(docs, "t_in")
    first = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))
    t = F.col(body)
    limits = [trees.thresholds.get(k) for k in KINDS]
    cut = F.array(*[F.lit(float("inf") if x is None else x) for x in limits])

    def extra(base: Column) -> Column:
        chosen = F.filter(proposals(t, base), lambda x: (trees.sql(x["f"]) >= F.get(cut, x["rank"]) - 1e-9) & ~F.exists(
            base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])
        ) & (x["f"]["generator"] >= len(BASE)))
        return F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    both = let(base_spans(t), lambda b: F.struct(b.alias("base"), F.array_sort(F.array_distinct(F.concat(b, extra(b)))).alias("spans")))
    return first.select(*[F.col(f"`{c}`") for c in kept], both.alias(result))


def written(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    merged = F.aggregate(spans, F.array().cast(SPAN), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.element_at(acc, -1)["rank"].alias("rank"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
        ))),
    ).otherwise(F.concat(acc, F.array(s))))

    def build(m: Column) -> Column:
        parts = F.transform(m, lambda s, i: F.concat(
            let(F.when(i > 0, F.get(m, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(F.lit(0)), lambda a: F.substring(text, a + 1, s["start"] - a)),
            F.get(names, s["rank"]),
        ))
        last = F.element_at(m, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text) - last))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) == 0, text).otherwise(let(merged, build))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", trees: Trees | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in the text; ``n_chars``, if there, follows.

    Rows without personal data stay as they are.
    """
    trees = trees or fit(docs, text)
    result = free_name(docs, "pii")
    found = scan(docs, trees, result, text)
    new = found.withColumn(text, masked(F.col(f"`{text}`"), F.col(result)["spans"]))
    if n_chars in docs.columns:
        new = new.withColumn(n_chars, F.when(F.size(F.col(result)["spans"]) > 0, F.length(F.col(f"`{text}`")).cast(docs.schema[n_chars].dataType)).otherwise(F.col(f"`{n_chars}`")))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs, fit(docs), "found", keep=["doc_id"])
    base = F.col("found.base")
    count = lambda r: F.size(F.filter(base, lambda s: s["rank"] == r)).cast("long")
    return found.select(
        "doc_id", *[count(r).alias(f"n_{k}") for r, k in enumerate(BASE)],
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found.spans")).alias("spans"),
    )
