"""Near-duplicate documents with SetSketch registers.

A document is the set of its distinct word shingles. Its *sketch* has ``M`` registers; one
holds the truncated logarithm, to the base ``BASE``, of the least of its elements' hashes
seen as exponential variates. Registers are mergeable by maximum and equal registers are the
likelier the more similar two sets are, so bands of ``ROWS`` registers find candidates, and
the numbers of registers that are larger, smaller and equal estimate the Jaccard similarity
of a pair jointly by maximum likelihood, given both set sizes. Pairs whose estimate lies
``SLACK`` below the threshold are dropped; the rest is verified on the full sets.

1. One pass over the texts gives set size, set digest and sketch per document. Equal sets
   are one class from here on, so copies cost one row each and never form pairs.
2. Every class meets the first class of each of its buckets (a star: linear, whatever the
   size of a bucket). Verified stars are contracted to components.
3. Buckets that still hold several components are compared and verified within tasks, chunk by
   chunk, across components only; a pair is looked at once, in its first common band, and only
   if its estimate may reach the threshold. Only links leave the task, and complete the components.

Texts are joined to what is to be verified; sets are built inside the task and compared there.
Nothing is gathered on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import annotate, free_name, materialize
from gleaner.llm.components import components
from gleaner.sources.tables import read_table

SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS, BANDS = 7, 36
M = ROWS * BANDS
BASE = 1.1
#: Six standard deviations of an estimate from ``M`` registers.
SLACK = 0.14
#: Classes of one chunk of a bucket; larger buckets are compared chunk by chunk.
CHUNK = 1024

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0x5851F42D4C957F2D)

FEATURES = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("set_id", T.BinaryType()),
    T.StructField("sketch", T.BinaryType()),
])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _POWER, np.uint64))


_TABLE = _powers(64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, A-Z in lower case."""
    b = np.frombuffer(text.translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    table = _TABLE if size.max() <= len(_TABLE) else _powers(int(size.max()))
    place = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b)))) if start[0] == 0 else None
    if place is None:
        place = np.arange(start[0], len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        b = b[start[0] :]
        end, start = end - start[0], start - start[0]
    held = inside[1:-1][-len(b) :]
    values = np.where(held, (b.astype(np.uint64) + np.uint64(1)) * table[np.minimum(place, len(table) - 1)], np.uint64(0))
    return mix(np.add.reduceat(values, start) + size.astype(np.uint64) * _MULTIPLIER)


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, of the whole sequence."""
    h = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    k = min(k, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _MULTIPLIER + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out + np.uint64(k)))


_SEEDS = mix(np.arange(1, M + 1, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes: truncated logarithms of the least exponential variate per register."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096, None] * _SEEDS
        part ^= part >> np.uint64(32)
        np.minimum(least, (part * _MULTIPLIER).min(0), out=least)
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    variate = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53))
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)) + 8, 0, 255).astype(np.uint8)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 101)


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood from register comparisons and set sizes.

    ``larger`` and ``smaller`` count the registers of a above and below those of b.
    """
    u = (n_a / np.maximum(n_a + n_b, 1))[:, None]
    j = np.minimum(_GRID, np.minimum(u, 1 - u) / np.maximum(u, 1 - u))  # no more than the sizes allow
    above, below = _p(np.clip(u - (1 - u) * j, 1e-9, 1)), _p(np.clip((1 - u) - u * j, 1e-9, 1))
    equal = np.clip(1 - above - below, 1e-9, 1)
    d0 = M - larger - smaller
    value = larger[:, None] * np.log(above) + smaller[:, None] * np.log(below) + d0[:, None] * np.log(equal)
    return j[np.arange(len(j)), value.argmax(1)]


def _similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: float, slack: float) -> np.ndarray:
    """Which row pairs of two register matrices may reach the threshold."""
    return estimate((a > b).sum(1), (a < b).sum(1), n_a, n_b) >= percent / 100 - slack


def describe(docs: DataFrame, text: str, result: str, keep: list[str], k: int = SHINGLE) -> DataFrame:
    """Rows with a struct ``result``: set size, 16-byte digest of the set (null: empty set), sketch."""

    def make():
        def work(texts):
            n, ids, sketches = [], [], []
            for text in texts:
                found = shingle_set(text, k)
                n.append(len(found))
                ids.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                sketches.append(sketch(found).tobytes() if len(found) else None)
            return [n, ids, sketches]

        return work

    return annotate(docs, text, result, FEATURES, make, keep)


def _band_keys(sketches: np.ndarray, width: int) -> np.ndarray:
    """(rows, M // width) keys: ``width`` registers, seven at most, and the band's number in eight bytes."""
    bands = M // width
    keys = np.zeros((len(sketches), bands, 8), np.uint8)
    keys[:, :, :width] = sketches[:, : bands * width].reshape(len(sketches), bands, width)
    keys[:, :, width] = np.arange(bands)
    return keys.view(np.int64)[:, :, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, M)


def _bands(classes: DataFrame, width: int) -> DataFrame:
    """(key, node, first): a row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _band_keys(_matrix(batch.column(2)), width) if batch.num_rows else np.zeros((0, M // width), np.int64)
            flat = pa.array(keys.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (M // width)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["node", "first", "keys"])

    rows = classes.select("node", "first", "sketch").mapInArrow(run, "node binary, first long, keys array<bigint>")
    return rows.select("node", "first", F.explode("keys").alias("key"))


def _candidates(pairs: DataFrame, classes: DataFrame, percent: float, slack: float) -> DataFrame:
    """Pairs (a, b) whose likelihood estimate may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                good = _similar(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b, percent, slack)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return rows.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, percent: float, k: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the threshold; ``texts`` has one text per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=64)
        def held(text: bytes) -> np.ndarray:
            return shingle_set(text, k)

        for batch in batches:
            good = []
            a, b = (batch.column(i).cast(pa.large_binary()).to_pylist() for i in (2, 3))
            for x, y in zip(a, b):
                x, y = shingle_set(x, k), held(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", "t_a", "t_b").mapInArrow(run, "a binary, b binary")


def _residual(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, block, own, node, root): classes of the buckets that stars didn't settle, for :func:`_across`.

    ``buckets`` has (key, node) of buckets with several classes. A bucket of more than
    ``CHUNK`` classes is dealt into chunks, and every pair of chunks is a group.
    """
    labelled = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = mixed.where("lo <> hi").select("key", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.struct(
        F.least(i, F.col("own")).alias("lo"), F.greatest(i, F.col("own")).alias("hi")))
    rows = labelled.join(mixed, "key").withColumn("own", own)
    return rows.select("key", "node", "root", "own", F.explode(meets).alias("block"))


def _across(rows: DataFrame, percent: float, k: int, width: int, slack: float) -> DataFrame:
    """Verified links (a, b) between components within the groups of :func:`_residual`.

    A pair is looked at in its first common band and only if its estimate may reach the
    threshold; pairs that the group has connected by then are passed over. What is emitted are
    links, never candidates.
    """

    def run(table: pa.Table) -> pa.Table:
        sketches, n = _matrix(table.column("sketch").combine_chunks()), table.column("n").to_numpy()
        own, key = table.column("own").to_numpy(), table.column("key")[0].as_py()
        block = table.column("block")[0].as_py()
        node, text = table.column("node"), table.column("text")
        root = np.unique(np.array(table.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        band = key.to_bytes(8, "little", signed=True)[width]
        keys = _band_keys(sketches, width)
        sets: dict[int, np.ndarray] = {}

        def set_of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(text[i].as_py().encode(), k)
            return sets[i]

        left, right = np.flatnonzero(own == block["lo"]), np.flatnonzero(own == block["hi"])
        found_a, found_b = [], []
        for i in left.tolist():
            j = right[right > i] if block["lo"] == block["hi"] else right
            j = j[(root[j] != root[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if len(j):
                j = j[~(keys[j, :band] == keys[i, :band]).any(1)]  # else an earlier band has the pair
            if len(j):
                j = j[_similar(sketches[j], sketches[i][None], n[j], np.full(len(j), n[i]), percent, slack)]
            for other in j.tolist():
                if root[other] != root[i]:
                    x, y = set_of(i), set_of(other)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found_a.append(node[i].as_py())
                        found_b.append(node[other].as_py())
                        root[root == root[other]] = root[i]
        return pa.table({"a": pa.array(found_a, pa.binary()), "b": pa.array(found_b, pa.binary())})

    rows = rows.select("key", "block", "own", "node", "root", "n", "sketch", "text")
    return rows.groupBy("key", "block").applyInArrow(run, "a binary, b binary")


def group(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: float = PERCENT, k: int = SHINGLE,
    width: int = ROWS, slack: float = SLACK,
) -> DataFrame:
    """(doc_id, text_id, n_shingles, set_id, component_id, kept) of every row of ``docs``.

    Rows with equal sets are one class; classes linked directly or through others share
    ``component_id``, the smallest id among their rows. ``kept`` marks the row of that id.
    A text without words (null, empty, blank) has no set, links with nothing and is kept. A
    null id never leads: such a row is kept only if its component has no id at all, which is
    then null. Rows repeated with the same id are all marked alike. Other columns are unread.
    ``width`` is the registers of a band (the lower the threshold, the fewer), ``slack`` what an
    estimate may lie below the threshold.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.withColumn("text_id", F.unhex(F.md5("text")))
    sets = describe(source, "text", "s", ["doc_id", "text_id"], k)
    sets = materialize(sets.select("doc_id", "text_id", "s.n", "s.set_id", "s.sketch"), "sets")
    full = sets.where(F.col("set_id").isNotNull())
    classes = full.groupBy(F.col("set_id").alias("node")).agg(
        F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_id")).alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"),
    )
    classes = materialize(classes, "classes")

    def texts_of(nodes: DataFrame, label: str) -> DataFrame:
        """(node, text): one text per class."""
        needed = classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_id").alias("rep_text"))
        # One row tells a class: that of its first id. Only rows repeated whole are several.
        texts = source.join(needed, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_id") == F.col("rep_text")))
        texts = texts.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("doc_id"))).where("r = 1").select("node", "text")
        return materialize(texts, f"{label}-texts")

    bands = _bands(classes, width)
    hubs = bands.groupBy("key").agg(F.min(F.struct("first", "node")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    hubs = hubs.select("key", F.col("hub.node").alias("hub"))
    buckets = materialize(bands.join(hubs, "key").select("key", "node", "hub"), "buckets")
    stars = buckets.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = materialize(_candidates(stars, classes, percent, slack), "stars-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    first = materialize(_verified(pairs, texts_of(nodes, "stars"), percent, k), "stars")
    roots = materialize(components(first), "roots")
    rows = materialize(_residual(buckets.select("key", "node"), roots), "residual-rows")
    texts = texts_of(rows.select("node"), "residual")
    rest = rows.join(classes.select("node", "n", "sketch"), "node").join(texts, "node")
    rest = materialize(_across(rest, percent, k, width, slack), "residual")
    links = first.unionByName(rest)
    roots = components(links)

    joined = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = joined.join(least, "root").select(F.col("node").alias("set_id"), "component_id")
    out = sets.select("doc_id", "text_id", "n", "set_id").join(by_class, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "text_id", F.col("n").alias("n_shingles"), "set_id", component.alias("component_id")).withColumn("kept", kept)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, with one document of each group of near-duplicates.

    It is the document with the smallest id; rows repeated whole, id and text, are reduced to one.
    Rows without words stay. Rows of one id with different texts are told apart by their sets.
    """
    groups = materialize(group(docs, doc_id, text, **options).where("set_id is not null"), "groups")
    out = groups.where("not kept").select("doc_id", "text_id").distinct()
    repeated = groups.where("kept").groupBy("doc_id", "text_id").count().where("count > 1").select("doc_id", "text_id")
    ids, digest = F.col(f"`{doc_id}`").cast("long"), F.unhex(F.md5(F.col(f"`{text}`").cast("string")))

    def of(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.toDF(left := free_name(docs, "key_id"), right := free_name(docs, "key_text"))
        return docs.join(keys, ids.eqNullSafe(F.col(left)) & (digest == F.col(right)), how)

    rank = free_name(docs, "rank_in")
    once = of(repeated, "left_semi").withColumn(rank, F.row_number().over(W.partitionBy(ids, digest).orderBy(ids))).where(F.col(rank) == 1)
    return of(out.unionByName(repeated), "left_anti").unionByName(once.select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
