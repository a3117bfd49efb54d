"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of every benchmark item (an
item of fewer words is one window). Per pattern length m the matcher has, as Wu and Manber
describe, for blocks of two symbols (words): a *shift table* (how far the search may jump if
this block ends at the current position; a block of no pattern allows m - 1 words), *buckets*
keyed by the hash of the block that ends a pattern, within them a prefix hash of the first
two words, and a direct comparison of the whole window. A clean document is probed once per
m - 1 words.

The search runs inside the rows, so a document never moves and no key can be hot. The
patterns reach the tasks as broadcasts of at most ``max_pattern_bytes`` of item text each. A
larger benchmark is searched in several blocks of items, each adding to the running result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import alnum_words, annotate, free_name
from gleaner.sources.tables import read_table

WINDOW = 13
#: Item text of one broadcast block of patterns.
MAX_PATTERN_BYTES = 32 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.IntegerType())),
])


class WuManber:
    """Matcher for patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[tuple, tuple]):
        self.m = length
        self.items = patterns
        self.shift: dict = {}
        self.buckets: dict = {}
        size = min(2, length)  # words of a block
        self.block = size
        buckets = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(size - 1, length):
                block = p[end - size + 1 : end + 1]
                step = length - 1 - end
                if step < self.shift.get(block, length):
                    self.shift[block] = step
            buckets[p[-size:]][p[:size]].append(p)
        self.buckets = {suffix: dict(by_prefix) for suffix, by_prefix in buckets.items()}

    def search(self, words: list[bytes]) -> Iterable[tuple[int, tuple]]:
        """(start, pattern) of every occurrence."""
        m, size, shift, buckets = self.m, self.block, self.shift.get, self.buckets
        jump = m - size + 1
        end, n = m - 1, len(words)
        while end < n:
            block = tuple(words[end - size + 1 : end + 1])
            step = shift(block, jump)
            if step:
                end += step
                continue
            start = end - m + 1
            for p in buckets[block].get(tuple(words[start : start + size]), ()):
                if tuple(words[start : end + 1]) == p:
                    yield start, p
            end += 1


def matchers(items: list[tuple[int | None, str | None]], window: int) -> list[WuManber]:
    """One matcher per pattern length of these (item_id, text) rows."""
    by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = alnum_words((text or "").encode())
        if words:
            m = min(window, len(words))
            for i in range(len(words) - m + 1):
                by_length[m][tuple(words[i : i + m])].add(item_id)
    return [
        WuManber(m, {p: tuple(i for i in ids if i is not None) for p, ids in found.items()})
        for m, found in sorted(by_length.items())
    ]


def _pattern_blocks(benchmark: DataFrame, item_id: str, text: str, max_bytes: int) -> list[list]:
    """Item rows in blocks of at most about ``max_bytes`` of text. One small job measures the table."""
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    items = items.where(F.col("t").isNotNull())
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = max(1, -(-2 * int(total) // max_bytes)) if total > max_bytes else 1
    part = F.pmod(F.xxhash64("t"), F.lit(n))
    return [[tuple(r) for r in items.where(part == k).collect()] for k in range(n)]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    result: str,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    max_pattern_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with a struct ``result``: n_words, n_hit, items, spans.

    ``items`` are the distinct ids of items with an occurring window, in no order; ``spans``
    the maximal runs of hit words as start, end pairs (end exclusive). A null or wordless text
    has no words; an item without words matches nothing; an item with a null id marks words
    but isn't listed. Repeated rows are judged alike. An empty benchmark hits nothing.
    """
    session = docs.sparkSession
    pattern_blocks = _pattern_blocks(benchmark, item_id, item_text, max_pattern_bytes)
    kept = docs.columns if keep is None else keep
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(free_name(docs, "body")))
    body = source.columns[-1]
    done = None
    for k, block in enumerate(pattern_blocks):
        shared = session.sparkContext.broadcast(matchers(block, window))
        last = k == len(pattern_blocks) - 1
        previous = result if done is not None else None
        source = done if done is not None else source
        done = _pass(source, body, previous, result, shared, [*kept] if last else [*kept, body])
    return done


def _pass(df: DataFrame, body: str, previous: str | None, result: str, shared, keep: list[str]) -> DataFrame:
    """Search one block of patterns and join its hits to those of the blocks before."""
    def make():
        found = shared.value

        def work(texts):
            n_words, n_hit, items, spans = [], [], [], []
            for text in texts:
                words = alnum_words(text) if text else []
                hit, ids = None, set()
                for matcher in found:
                    for start, pattern in matcher.search(words):
                        if hit is None:
                            hit = bytearray(len(words))
                        hit[start : start + matcher.m] = b"\x01" * matcher.m
                        ids.update(matcher.items[pattern])
                n_words.append(len(words))
                n_hit.append(hit.count(1) if hit else 0)
                items.append(sorted(ids))
                spans.append(runs(hit) if hit else [])
            return [n_words, n_hit, items, spans]

        return work

    if previous is None:
        return annotate(df, body, result, FOUND, make, keep)
    fresh = free_name(df, "fresh")
    both = annotate(df, body, fresh, FOUND, make, [*keep, previous])
    a, b = F.col(f"`{previous}`"), F.col(f"`{fresh}`")
    merged = merge_spans(F.concat(a["spans"], b["spans"]))
    joined = F.struct(
        a["n_words"].alias("n_words"), covered(merged).alias("n_hit"),
        F.array_union(a["items"], b["items"]).alias("items"), merged.alias("spans"),
    )
    return both.select(*[F.col(f"`{c}`") for c in keep], joined.alias(result))


def runs(hit: bytearray) -> list[int]:
    """Start, end pairs of the runs of ones."""
    out, at = [], hit.find(1)
    while at >= 0:
        end = hit.find(0, at)
        end = len(hit) if end < 0 else end
        out += [at, end]
        at = hit.find(1, end)
    return out


def merge_spans(flat):
    """Flat start, end pairs, overlapping or not, as sorted disjoint pairs."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(flat) / 2 - 1, F.lit(0)).cast("int")),
                        lambda i: F.struct(F.get(flat, 2 * i).alias("s"), F.get(flat, 2 * i + 1).alias("e")))
    ordered = F.array_sort(F.filter(pairs, lambda p: p["s"].isNotNull()))
    return F.aggregate(
        ordered, F.array().cast("array<int>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) >= p["s"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                     F.array(F.greatest(F.get(acc, F.size(acc) - 1), p["e"]))),
        ).otherwise(F.concat(acc, F.array(p["s"], p["e"]))),
    )


def covered(flat):
    """Number of positions inside disjoint start, end pairs."""
    signed = F.transform(flat, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda acc, x: acc + x)


def contaminated(found):
    """At least one word in twenty is hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text isn't contaminated by a benchmark item."""
    result = free_name(docs, "decon")
    found = scan(docs, benchmark, result, text, **options)
    return found.where(~contaminated(F.col(result))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs, read_table(spark, sf_dir, "benchmark"), "found", keep=["doc_id"])
    f = F.col("found")
    items = F.array_join(F.array_sort(F.transform(f["items"], lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
        contaminated(f).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format('text')}, []) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)
),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
),
hits AS (SELECT doc_id, item_id, m, i FROM dw JOIN bw USING (m, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n > 0 AND 20 * h.n >= len(w), false) AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""
