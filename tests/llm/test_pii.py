from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from gleaner.llm import pii

from .helpers import ODD, as_rows, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if plain_valid(kind, m[0])]
    return ",".join(x for *_, x in sorted(found))


def texts():
    rng = random.Random(9)
    parts = ["a", "é", "@", ".", "x.y", "-", "+", "1", "12", "255", "256", "007", " ", "(", ")", "mail@b.co", "4111 1111 1111 1111",
             "10.0.0.1", "+1 (212) 555-0101", "_", "%", "\U0001f600", "9" * 25, "com"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 24))) for _ in range(400)]
    return out + ["a@b.com_x@c.de@e.fr", "1.2.3.4.5.6.7.8", "1 " * 3000 + "4", "+" * 50 + "1" * 12, "a" * 5000 + "@b.c", "", None]


def trees():
    return pii.Trees(0.0, [], dict.fromkeys(pii.KINDS))


def test_base_equals_brute_force(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts())] + ODD
    got = pii.scan(table(spark, rows).drop("found"), trees(), "found", keep=["doc_id", "text"]).select("text", pii.written(F.col("found.base")).alias("w"), "found").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.w == brute(r.text), r.text
        assert r.found.base == r.found.spans


def test_learns_tokens_and_masks_them(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)) + "a1"
    rows = [(i, f'see token = "{key()}" and call +1 (212) 555-{1000 + i} or mail u{i}@x.org, card 4111111111111112', "en", "s", 90) for i in range(150)]
    rows += [(500 + i, f"the chapter {key()[:20]} of the book", "en", "s", 30) for i in range(150)]
    docs = table(spark, rows + [(9000 + k, *r[1:]) for k, r in enumerate(ODD)])
    model = pii.fit(docs)
    assert model.thresholds["secret"] is not None
    out = {r.doc_id: r for r in pii.redact(docs, trees=model).collect()}
    assert out[7].text == 'see token = "[SECRET]" and call [PHONE] or mail [EMAIL], card 4111111111111112'
    assert out[7].n_chars == len(out[7].text)
    assert out[507].text == dict((r[0], r[1]) for r in rows)[507]
    untouched = [tuple(r) for i, r in out.items() if i >= 9000]
    assert sorted((r[1:5] for r in untouched), key=repr) == sorted((r[1:] for r in ODD), key=repr)


def test_masking_overlaps(spark):
    df = spark.createDataFrame([("0123456789",)], "t string")
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(k).alias("rank"), F.lit(b).alias("end")) for a, k, b in ((1, 0, 4), (3, 2, 6), (8, 3, 9))])
    assert df.select(pii.masked(F.col("t"), spans)).first()[0] == "0[EMAIL]67[PHONE]9"


def test_nothing_to_learn_from(spark):
    df = table(spark, ODD)
    assert as_rows(pii.redact(df)) == as_rows(df)
    assert pii.redact(table(spark, [])).collect() == []
