from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def esc(s):
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def formatted(role, text):
    return f"<|im_start|>{esc(role.replace(chr(92), chr(92) + 's').replace(chr(10), chr(92) + 'n'))}\n{esc(text)}<|im_end|>\n"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def ordered(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: sorted(v) for c, v in convs.items()}


def expected(rows, budget, history, history_turns, bits):
    """(conv, text, texts under the mask) of every window, by plain loops."""
    cost = lambda r, x: -(-len(formatted(r, x).encode()) // 4)
    out = []
    for c, turns in ordered(rows).items():
        first = turns[0]
        system = [turns.pop(0)[2:]] if first[2] == "system" else []
        base, last, made = sum(cost(*s) for s in system), None, []
        of = lambda t: t[1] >> bits if t[0] else None
        if system and (not turns or of(turns[0]) != of(first)):
            made.append([])
        for j, t in enumerate(turns):
            room = budget - base
            if j and of(t) == of(turns[j - 1]) and sum(cost(*u[2:]) for u in turns[last : j + 1]) <= room:
                made[-1].append(t[2:])
                continue
            last, used = j, 0
            while last > 0 and j - last < history_turns:
                b = turns[last - 1]
                near = of(b) is not None and of(t) is not None and (of(b) == of(t) or (of(b) == of(t) - 1 and b[1] % (1 << bits) >= (1 << bits) - history_turns))
                near = near or of(b) == of(t)
                used += cost(*b[2:])
                if not near or used > min(history, room - cost(*t[2:])):
                    break
                last -= 1
            made.append([("", x) for x in turns[last:j]] + [t[2:]])
        for w in made:
            old = [x[1][2:] for x in w if x[0] == "" and isinstance(x[1], tuple)]
            new = [x for x in w if not isinstance(x[1], tuple)]
            out.append((c, "".join(formatted(*x) for x in [*system, *old, *new]), [x for r, x in new if r == "assistant"]))
    return sorted(out, key=repr)


def got(df, **options):
    found = chat.windows(df, **options).select("*", chat.read_targets(F.col("text"), F.col("loss")).alias("targets"))
    return found


def whole(rows):
    """What the digests must say, from the turns alone."""
    out = []
    for c, turns in ordered(rows).items():
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def digest_rows(found):
    rows = chat.digests(found).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()
    return sorted(map(tuple, rows), key=repr)


ODD = [
    (1, 0, "system", "be <|im_end|> brief"), (1, 1, "user", chat.PLANTED), (1, 2, "assistant", "<\\|im_end|> \\ <\\\\| é🙂"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (2, None, "user", "no number"),
    (3, 5, "system", "alone"), (4, 0, None, "nobody"), (4, 3, "we\\ird\n<|role", "x<"), (4, 4, "assistant", "|<|<<||>"),
    (None, 0, "user", "null"), (None, 900, "assistant", "later section of null"), (5, 1, "assistant", "long " * 60_000), (5, 2, "user", "after"),
    (6, -5, "system", "negative"), (6, -4, "assistant", "a"), (6, 700, "system", "later system"), (6, 701, "assistant", "b"),
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("rows", "kind", "section", "own", "spans", "w", "body"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_odd_rows_come_back(spark):
    df = frame(spark, ODD)
    found = got(df).cache()
    assert digest_rows(found) == whole(ODD)
    assert digest_rows(got(df.repartition(5), budget=20, history=12, section_bits=3)) == whole(ODD)
    assert found.where("conv_id = 3").select("n_turns", "n_repeated", "text").collect() == [(1, 0, formatted("system", "alone"))]
    assert all(sum(1 for _ in re.finditer(r"<\|", r.text)) == 2 * r.n_turns for r in found.collect())
    assert chat.digests(got(df.limit(0))).collect() == []


@pytest.mark.parametrize(("budget", "history", "turns", "bits"), [(60, 20, 3, 2), (40, 0, 0, 5), (200, 100, 8, 3), (1024, 128, 8, 7)])
def test_windows_equal_plain_loops(spark, budget, history, turns, bits):
    rng = random.Random(budget)
    rows = []
    for c in range(25):
        n, at = rng.choice([1, 2, 5, 9, 40]), 0
        for k in range(n):
            at += rng.choice([1, 1, 1, 2, 9]) if k else 0
            role = "system" if k == 0 and c % 3 == 0 else "user" if k % 2 else "assistant"
            rows.append((c, at, role, "ab <| é\n" * rng.choice([0, 1, 2, 5, 30])))
    found = got(frame(spark, rows).repartition(3), budget=budget, history=history, history_turns=turns, section_bits=bits)
    made = found.collect()
    assert sorted(((r.conv_id, r.text, r.targets) for r in made), key=repr) == expected(rows, budget, history, turns, bits)
    assert digest_rows(found) == whole(rows)
    assert all(r.n_tokens <= budget or r.n_turns - r.n_repeated <= 1 + r.text.startswith("<|im_start|>system") for r in made)
    assert all(r.n_repeated <= turns + 1 for r in made)


def test_token_counts_may_be_given(spark):
    rows = [(1, k, "user", "x") for k in range(10)]
    found = got(frame(spark, rows), budget=3, history=1, tokens=lambda f: F.lit(1).cast("long")).orderBy("window").collect()
    assert [(r.n_turns, r.n_repeated, r.n_tokens) for r in found] == [(3, 0, 3), (3, 1, 3), (3, 1, 3), (3, 1, 3), (2, 1, 2)]


def test_one_exchange_of_texts_and_no_python(spark):
    df = chat.digests(chat.windows(frame(spark, ODD)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
