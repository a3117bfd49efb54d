"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets a few rates (symbols, repeated lines, repeated word windows, word
length). A *sketch* of a rate is a histogram over buckets of bounded relative error: values
below 16 have a bucket each, larger ones eight buckets per power of two. Sketches merge by
adding counts, so they are an ordinary aggregation with a map-side part: one bounded row set
per language, source and rate, whatever the number of documents.

Thresholds are Tukey fences from the quartiles of the sketch of a document's language and
source. A sketch is always merged with that of the whole language, weighted as ``PRIOR``
documents: a small source leans on its language and a large one stands for itself, with no
switch between the two. The final filter joins the fences to the rates; texts are read once
and never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.common import free_name, materialize
from gleaner.sources.tables import read_table

# Fixed values of the contract.
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: Documents that the sketch of the language counts for in the sketch of a source.
PRIOR = 200
#: Fences lie so many quartile distances outside the quartiles, and this far at least (in units of the rate).
REACH = 3
#: rate -> (least distance of the fence, has a lower fence, has an upper fence). Rates are per ten thousand, word length in hundredths.
RATES = {
    "symbol_rate": (300, False, True),
    "dup_line_rate": (3000, False, True),
    "repeat_rate": (1000, False, True),
    "word_length": (300, True, True),
}
NONE = "\x00"


def flat(text: Column) -> Column:
    """The text with every white space character of the contract as a blank; null: empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(" "))
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(flat(text), " "), "")


def repeated_words(w: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        )

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(places, j + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x).cast("long")

    def twice(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(
            ordered,
            lambda s: let(
                F.array_sort(F.transform(
                    F.filter(s, lambda a, j: F.coalesce(
                        (a["x"] == F.get(s, j + 1)["x"]) | ((j > 0) & (a["x"] == F.get(s, F.greatest(j - 1, F.lit(0)))["x"])),
                        (j > 0) & (a["x"] == F.get(s, F.greatest(j - 1, F.lit(0)))["x"]),
                    )),
                    lambda a: a["i"],
                )),
                covered,
            ),
        )

    return let(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: let(
            windows(h),
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(twice(g)),
        ),
    )


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and a struct ``m``: counts, rates and ``base_failed`` of each text."""
    kept = docs.columns if keep is None else keep
    name, held = free_name(docs, "m"), free_name(docs, "w_in")
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" " + SPACES)) != "")
    counts = let(words(F.col(f"`{text}`")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"),
    ))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    chars = F.length(F.replace(flat(F.col(f"`{text}`")), F.lit(" "), F.lit(""))).cast("long")
    first = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.struct(
            counts.alias("c"), by_line.alias("l"), chars.alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        ).alias(held),
    )
    h = F.col(held)
    n, rep = h["c"]["n_words"], h["c"]["n_repeat_words"]
    return first.select(*[F.col(f"`{c}`") for c in kept], F.struct(
        n.alias("n_words"), h["word_chars"].alias("word_chars"), h["n_symbols"].alias("n_symbols"),
        h["l"]["n_dup_lines"].alias("n_dup_lines"), rep.alias("n_repeat_words"),
        F.expr(f"(10000 * {held}.n_symbols) div greatest({held}.word_chars, 1)").alias("symbol_rate"),
        F.expr(f"(10000 * {held}.l.n_dup_lines) div greatest({held}.l.n_lines, 1)").alias("dup_line_rate"),
        F.expr(f"(10000 * {held}.c.n_repeat_words) div greatest({held}.c.n_words, 1)").alias("repeat_rate"),
        F.expr(f"(100 * {held}.word_chars) div greatest({held}.c.n_words, 1)").alias("word_length"),
        ((n < MIN_WORDS) | (100 * rep > MAX_REPEATED_PERCENT * n)).alias("base_failed"),
    ).alias(name))


def bucket_of(value: str) -> str:
    """SQL of the bucket of a non-negative integer; the same text serves both engines."""
    shift = f"greatest(length(bin({value})) - 4, 0)"
    return f"(8 * {shift} + ({value} >> CAST({shift} AS INT)))"


def lowest(bucket: str) -> str:
    """SQL of the least value of a bucket."""
    return f"(CASE WHEN {bucket} < 16 THEN {bucket} ELSE (({bucket} % 8) + 8) << CAST(floor({bucket} / 8) - 1 AS INT) END)"


def highest(bucket: str) -> str:
    return f"(CASE WHEN {bucket} < 16 THEN {bucket} ELSE ((({bucket} % 8) + 9) << CAST(floor({bucket} / 8) - 1 AS INT)) - 1 END)"


def sketch(measured: DataFrame, m: str, lang: str, source: str) -> DataFrame:
    """(lang, source, rate, bucket, n) of all rows."""
    long = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"{m}.{r}").alias("v")) for r in RATES]))
    rows = measured.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE)).alias("lang_key"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE)).alias("source_key"), long.alias("x"),
    ).select("lang_key", "source_key", "x.rate", F.expr(bucket_of("x.v")).cast("int").alias("bucket"))
    return rows.groupBy("lang_key", "source_key", "rate", "bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, rate, low, high): fences from each sketch merged with that of its language."""
    by_lang = sketches.groupBy("lang_key", "rate", "bucket").agg(F.sum("n").alias("n_lang"))
    lang_size = sketches.groupBy("lang_key", "rate").agg(F.sum("n").alias("size_lang"))
    pairs = sketches.select("lang_key", "source_key", "rate").distinct()
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  exact sums, so any order of adding gives the same fence
    merged = (
        pairs.join(by_lang, ["lang_key", "rate"]).join(lang_size, ["lang_key", "rate"])
        .join(sketches, ["lang_key", "source_key", "rate", "bucket"], "left")
        .select(
            "lang_key", "source_key", "rate", "bucket",
            (F.coalesce(wide("n"), F.lit(0)) * wide("size_lang") + F.lit(prior) * wide("n_lang")).alias("w"),
        )
    )
    # A group is one sketch: at most some hundred buckets.
    group = W.partitionBy("lang_key", "source_key", "rate")
    ranked = merged.withColumns({"upto": F.sum("w").over(group.orderBy("bucket")), "total": F.sum("w").over(group)})
    return ranked.groupBy("lang_key", "source_key", "rate").agg(
        F.min(F.expr(f"CASE WHEN 4 * upto >= total THEN {lowest('bucket')} END")).alias("q1"),
        F.min(F.expr(f"CASE WHEN 4 * upto >= 3 * total THEN {highest('bucket')} END")).alias("q3"),
    )


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, prior: int = PRIOR
) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``m`` (see :func:`measure`) and ``kept``.

    A null text has no words and fails the base rules. Null languages and sources form groups
    of their own. Repeated rows count repeatedly in the sketches and are judged alike.
    """
    kept = docs.columns if keep is None else keep
    carried = list(dict.fromkeys([*kept, lang, source]))
    m = free_name(docs, "m")
    measured = materialize(measure(docs, text, carried), "rules")
    found = fences(sketch(measured, m, lang, source), prior)
    wide = found.groupBy("lang_key", "source_key").agg(F.map_from_entries(F.collect_list(F.struct("rate", F.struct("q1", "q3")))).alias("fence"))
    lang_key, source_key, fence = free_name(measured, "lang_key"), free_name(measured, "source_key"), free_name(measured, "fence")
    wide = wide.toDF(lang_key, source_key, fence)
    keyed = measured.withColumns({
        lang_key: F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NONE)),
        source_key: F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NONE)),
    })
    good = ~F.col(m)["base_failed"]
    for rate, (least, has_low, has_high) in RATES.items():
        f, v = F.col(fence)[rate], F.col(m)[rate]
        room = F.greatest(REACH * (f["q3"] - f["q1"]), F.lit(least))
        if has_high:
            good = good & (v <= f["q3"] + room)
        if has_low:
            good = good & (v >= f["q1"] - room)
    return keyed.join(wide, [lang_key, source_key], "left").select(
        *[F.col(f"`{c}`") for c in kept], F.col(m), F.coalesce(good, F.lit(False)).alias(free_name(docs, "kept"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return judge(docs, keep=["doc_id"]).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "m.base_failed", "kept",
    )


def _oracle() -> str:
    base = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '{NONE}') AS lang_key, coalesce(source, '{NONE}') AS source_key FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
    g AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
      FROM (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}))
    ),
    r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM g WHERE n > 1) GROUP BY doc_id),
    m AS (
      SELECT w.doc_id, lang_key, source_key, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)
    ),
    x AS (
      SELECT *, (10000 * n_symbols) // greatest(word_chars, 1) AS symbol_rate, (10000 * n_dup_lines) // greatest(n_lines, 1) AS dup_line_rate,
        (10000 * n_repeat_words) // greatest(n_words, 1) AS repeat_rate, (100 * word_chars) // greatest(n_words, 1) AS word_length,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed
      FROM m
    ),
    v AS (UNPIVOT (SELECT lang_key, source_key, {', '.join(RATES)} FROM x) ON {', '.join(RATES)} INTO NAME rate VALUE v),
    s AS (SELECT lang_key, source_key, rate, {bucket_of('v')} AS bucket, count(*) AS n FROM v GROUP BY ALL),
    sl AS (SELECT lang_key, rate, bucket, sum(n) AS n_lang FROM s GROUP BY ALL),
    zl AS (SELECT lang_key, rate, sum(n) AS size_lang FROM s GROUP BY ALL),
    p AS (SELECT DISTINCT lang_key, source_key, rate FROM s),
    u AS (
      SELECT p.lang_key, p.source_key, p.rate, sl.bucket, coalesce(s.n, 0)::HUGEINT * size_lang + {PRIOR} * n_lang AS w
      FROM p JOIN sl USING (lang_key, rate) JOIN zl USING (lang_key, rate)
      LEFT JOIN s ON s.lang_key = p.lang_key AND s.source_key = p.source_key AND s.rate = p.rate AND s.bucket = sl.bucket
    ),
    c AS (
      SELECT *, sum(w) OVER (PARTITION BY lang_key, source_key, rate ORDER BY bucket) AS upto,
        sum(w) OVER (PARTITION BY lang_key, source_key, rate) AS total FROM u
    ),
    f AS (
      SELECT lang_key, source_key, rate, min(CASE WHEN 4 * upto >= total THEN {lowest('bucket')} END) AS q1,
        min(CASE WHEN 4 * upto >= 3 * total THEN {highest('bucket')} END) AS q3
      FROM c GROUP BY ALL
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed"""
    tail = "\n    FROM x"
    for k, (rate, (least, low, high)) in enumerate(RATES.items()):
        tail += f" JOIN f f{k} ON f{k}.lang_key = x.lang_key AND f{k}.source_key = x.source_key AND f{k}.rate = '{rate}'"
        room = f"greatest({REACH} * (f{k}.q3 - f{k}.q1), {least})"
        base += f" AND {rate} <= f{k}.q3 + {room}" * high + f" AND {rate} >= f{k}.q1 - {room}" * low
    return base + " AS kept" + tail


ORACLE = _oracle()
