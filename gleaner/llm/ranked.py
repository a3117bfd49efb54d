"""Ranked lexical search: an inverted index in segments, searched by Block-Max MaxScore.

**Index.** A task cuts its documents into segments (so many documents or bytes of text) and
writes one row per segment and term: the posting list in blocks of 128, gaps and frequencies in
one to four bytes, and beside it a header per block with its last document, largest frequency
and smallest document length. Header and bytes are separate columns, so that a block can be
judged without decompressing it. A row without a term holds ids and lengths of the segment's
documents. A word of every document is one row per segment, never one large list.

**Search.** Queries reach the tasks in batches of bounded size; the index rows of their terms meet
by segment. A task keeps one heap per query over all of its segments (its shard). Per segment and
query the terms are ordered by the largest score that they can add there. The longest prefix whose
bounds sum to less than the heap's worst score is *non-essential*: a document with none but these
terms can't enter. Documents of the essential lists are candidates; the block maxima of the
non-essential lists reject candidates before any block is decompressed, and then list by list. The
heaps of the shards are merged by a limited row number.

Frequency f and length n bound a block from above, since the score grows with f and falls with n;
so the index needs no corpus statistics and can be built in one pass.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import alnum_words, blocks, materialize
from gleaner.sources.tables import read_table

#: Highest-scoring documents of a query.
TOP = 50
#: Postings of a block.
BLOCK = 128
#: A segment is closed at so many documents or bytes of text; ordinals fit in two bytes.
SEGMENT_DOCS = 1 << 15
SEGMENT_BYTES = 12 << 20
#: Query text of a batch: what the driver and every task hold of the queries at once.
QUERY_BYTES = 4 << 20

HEADER = np.dtype([
    ("last", "<u2"), ("count", "u1"), ("gap_width", "u1"), ("tf_width", "u1"),
    ("max_tf", "<u4"), ("min_n", "<u4"), ("at", "<u4"),
])
INDEX = T.StructType([
    T.StructField("segment", T.LongType()),
    T.StructField("term", T.BinaryType()),
    T.StructField("df", T.LongType()),
    T.StructField("header", T.BinaryType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("n_docs", T.LongType()),
    T.StructField("n_terms", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
])
_ARROW = pa.schema([
    ("segment", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("header", pa.binary()), ("data", pa.binary()),
    ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
])
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_PIECE = 1 << 20


def pieces(text: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words."""
    start = 0
    while len(text) - start > size:
        cut = _SEPARATOR.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class Segment:
    """Postings of some documents."""

    def __init__(self):
        self.vocabulary: dict = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list = []
        self.lengths: list[int] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        code_of, found = self.vocabulary.__getitem__, []
        for piece in pieces(text or b""):
            words = alnum_words(piece)
            found.append(np.fromiter(map(code_of, words), np.int32, len(words)))
        all_codes = found[0] if len(found) == 1 else np.concatenate(found)
        codes, counts = np.unique(all_codes, return_counts=True)
        self.ids.append(doc_id)
        self.lengths.append(len(all_codes))
        self.codes.append(codes)
        self.counts.append(counts)
        self.bytes += len(text or b"")

    def full(self, docs: int, size: int) -> bool:
        return len(self.ids) >= docs or self.bytes >= size

    def rows(self, number: int, block: int) -> Iterator[pa.RecordBatch]:
        """Index rows: one for the documents, one per term."""
        n = np.array(self.lengths, np.int64)
        yield pa.record_batch(
            [[number], [None], [None], [None], [None], [int((n > 0).sum())], [int(n.sum())], [self.ids], [self.lengths]], schema=_ARROW
        )
        if not self.vocabulary:
            return
        codes, tf = np.concatenate(self.codes), np.concatenate(self.counts).astype(np.int64)
        docs = np.repeat(np.arange(len(n)), [len(c) for c in self.codes])
        order = np.argsort(codes, kind="stable")
        codes, tf, docs = codes[order], tf[order], docs[order]
        df = np.bincount(codes, minlength=len(self.vocabulary))
        starts = np.concatenate([[0], np.cumsum(df)[:-1]])
        inside = (np.arange(len(codes)) - np.repeat(starts, df)) % block
        first = np.flatnonzero(inside == 0)
        count = np.diff(np.append(first, len(codes)))
        gap = np.where(inside == 0, docs, docs - np.concatenate([[0], docs[:-1]]))
        header = np.zeros(len(first), HEADER)
        header["last"], header["count"] = docs[first + count - 1], count
        header["max_tf"] = np.maximum.reduceat(tf, first)
        header["min_n"] = np.minimum(np.minimum.reduceat(n[docs], first), 0xFFFFFFFF)
        header["gap_width"] = np.where(np.maximum.reduceat(gap, first) < 256, 1, 2)
        header["tf_width"] = np.where(header["max_tf"] < 256, 1, 4)
        size = count * (header["gap_width"].astype(np.int64) + header["tf_width"])
        begin = np.concatenate([[0], np.cumsum(size)])
        per_term = -(-df // block)  # blocks of each list
        head = np.concatenate([[0], np.cumsum(per_term)])
        header["at"] = begin[:-1] - np.repeat(begin[head[:-1]], per_term)
        data = np.zeros(begin[-1], np.uint8)
        gap_width, tf_width = np.repeat(header["gap_width"], count).astype(np.int64), np.repeat(header["tf_width"], count).astype(np.int64)
        at = np.repeat(begin[:-1], count) + inside * gap_width
        _put(data, at, gap, gap_width)
        _put(data, np.repeat(begin[:-1] + count * header["gap_width"], count) + inside * tf_width, tf, tf_width)
        terms = pa.array(list(self.vocabulary), pa.binary())
        k, none = len(terms), pa.nulls
        yield pa.record_batch([
            pa.array(np.full(k, number)), terms, pa.array(df.astype(np.int64)),
            _binary(head * HEADER.itemsize, header.tobytes()), _binary(begin[head], data.tobytes()),
            none(k, pa.int64()), none(k, pa.int64()), none(k, pa.list_(pa.int64())), none(k, pa.list_(pa.int64())),
        ], schema=_ARROW)


def _put(data: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    """Little-endian values of one to four bytes."""
    for i in range(int(width.max())):
        wide = width > i
        data[at[wide] + i] = (value[wide] >> (8 * i)) & 255


def _binary(offsets: np.ndarray, data: bytes) -> pa.Array:
    offsets = offsets.astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def decode(header: np.void, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document ordinals and frequencies of a block."""
    count, at = int(header["count"]), int(header["at"])
    gaps = np.frombuffer(data, f"<u{header['gap_width']}", count, at)
    tf = np.frombuffer(data, f"<u{header['tf_width']}", count, at + count * int(header["gap_width"]))
    return np.cumsum(gaps, dtype=np.int64), tf.astype(np.int64)


def build_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_docs: int = SEGMENT_DOCS,
    segment_bytes: int = SEGMENT_BYTES, block: int = BLOCK,
) -> DataFrame:
    """The index of all rows of ``docs``, as a table in the shared folder.

    Every row is a document, repeated rows and ids too; ids are cast to long and may be null. A
    null, empty or wordless text is a document without terms. A text longer than a segment is a
    segment of its own, read in pieces. An empty table gives an empty index. Further columns of
    ``docs`` are not read.
    """
    if not 0 < segment_docs <= 1 << 16 or not 0 < block < 256:
        raise ValueError("ordinals take two bytes, counts of a block one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, segment = TaskContext.get().partitionId(), 0, Segment()
        for batch in batches:
            for part, texts in blocks(batch, "t"):
                for i, body in zip(part.column("i").to_pylist(), texts, strict=True):
                    segment.add(i, body)
                    if segment.full(segment_docs, segment_bytes):
                        yield from segment.rows(task << 32 | number, block)
                        segment, number = Segment(), number + 1
        if segment.ids:
            yield from segment.rows(task << 32 | number, block)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return materialize(rows.mapInArrow(run, INDEX), "ranked-index")


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 50 + (50 * n * n_docs) // n_terms


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds: grows with ``tf``, falls with the length."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


class Lists:
    """Posting lists of one segment for the terms of a batch of queries."""

    def __init__(self, lengths: list[int], n_docs: int, n_terms: int):
        self.stats = n_docs, n_terms
        self.norm = length_norm(np.array(lengths, np.int64), n_docs, n_terms) if n_terms else np.zeros(len(lengths), np.int64)
        self.lists: dict[int, tuple] = {}
        self.ready: dict = {}
        self.decoded = 0

    def add(self, code: int, weight_of: int, header: bytes, data: bytes) -> None:
        head = np.frombuffer(header, HEADER)
        bound = weight_of * impact(head["max_tf"].astype(np.int64), length_norm(head["min_n"].astype(np.int64), *self.stats))
        self.lists[code] = (weight_of, head, data, bound, int(bound.max()))

    def bound(self, code: int) -> int:
        return self.lists[code][4]

    def block(self, code: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        made = self.ready.get((code, number))
        if made is None:
            weight_of, head, data, _, _ = self.lists[code]
            docs, tf = decode(head[number], data)
            made = self.ready[code, number] = docs, weight_of * impact(tf, self.norm[docs])
            self.decoded += 1
        return made

    def whole(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        made = self.ready.get(code)
        if made is None:
            parts = [self.block(code, b) for b in range(len(self.lists[code][1]))]
            made = self.ready[code] = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        return made

    def search(self, codes: list[int], worst: int) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals and scores of all documents whose score is at least ``worst`` (and above 0)."""
        worst = max(worst, 1)
        mine = sorted((c for c in codes if c in self.lists), key=self.bound)
        rest, split = 0, 0  # the bounds of the non-essential lists sum to less than the worst score
        while split < len(mine) and rest + self.bound(mine[split]) < worst:
            rest += self.bound(mine[split])
            split += 1
        score = np.zeros(len(self.norm), np.int64)
        for code in mine[split:]:
            docs, value = self.whole(code)
            score[docs] += value
        found = np.flatnonzero(score)
        found = found[score[found] + rest >= worst]
        checks = []  # per non-essential list, largest first: block of each candidate and its bound
        for code in reversed(mine[:split]):
            _, head, _, bound, _ = self.lists[code]
            at = np.searchsorted(head["last"], found)
            checks.append([code, at, np.append(bound, 0)[at]])
        open_bound = sum((c[2] for c in checks), np.zeros(len(found), np.int64))
        for k, (code, _, _) in enumerate(checks):
            keep = score[found] + open_bound >= worst
            if not keep.all():
                found, open_bound = found[keep], open_bound[keep]
                for c in checks[k:]:
                    c[1], c[2] = c[1][keep], c[2][keep]
            _, at, upper = checks[k]
            for b in np.unique(at[upper > 0]):
                docs, value = self.block(code, int(b))
                asked = found[(at == b)]
                spot = np.minimum(np.searchsorted(docs, asked), len(docs) - 1)
                hit = docs[spot] == asked
                score[asked[hit]] += value[spot[hit]]
            open_bound = open_bound - upper
        total = score[found]
        keep = total >= worst
        return found[keep], total[keep]


class Heap:
    """The best documents of a query: highest score, then smallest id, null ids last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def worst(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 0

    def push(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if len(score) > 0:
            score, ids, null = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.null, null)))
            best = np.lexsort((ids, null, -score))[: self.top]
            self.score, self.id, self.null = score[best], ids[best], null[best]


RESULT = "query long, score long, doc_id long"
_FOUND = pa.schema([("query", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])


def _search_batch(index: DataFrame, texts: list[str], first: int, stats: tuple[int, int], top: int) -> DataFrame:
    """Shard heaps of queries ``first``, ``first`` + 1, ... as rows query, score, doc_id."""
    spark = index.sparkSession
    code: dict[bytes, int] = {}
    asked = [sorted({code.setdefault(w, len(code)) for w in alnum_words((t or "").encode())}) for t in texts]
    terms = F.broadcast(spark.createDataFrame([(w, c) for w, c in code.items()], "term binary, code long"))
    lists = index.where("term IS NOT NULL").join(terms, "term")
    df = {r["code"]: r["df"] for r in lists.groupBy("code").agg(F.sum("df").alias("df")).collect()}
    weights = {c: weight(stats[0], n) for c, n in df.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(top) for _ in asked]
        now = segment = ids = null = None

        def finish():
            for codes, heap in zip(asked, heaps, strict=True):
                docs, score = segment.search(codes, heap.worst())
                heap.push(score, ids[docs], null[docs])

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] != now:
                    if segment is not None:
                        finish()
                    now, segment = row["segment"], Lists(row["lengths"], *stats)
                    null = np.array([i is None for i in row["ids"]], bool)
                    ids = np.array([i or 0 for i in row["ids"]], np.int64)
                elif weights[row["code"]] > 0:
                    segment.add(row["code"], weights[row["code"]], row["header"], row["data"])
        if segment is not None:
            finish()
        for q, heap in enumerate(heaps):
            if len(heap.score):
                yield pa.record_batch([
                    pa.array(np.full(len(heap.score), first + q)), pa.array(heap.score), pa.array(heap.id, mask=heap.null),
                ], schema=_FOUND)

    columns = ["segment", "code", "header", "data", "ids", "lengths"]
    owners = index.where("term IS NULL").withColumn("code", F.lit(-1).cast("long"))
    rows = owners.select(*columns).unionByName(lists.select(*columns))
    return rows.repartition("segment").sortWithinPartitions("segment", "code").mapInArrow(run, RESULT)


def search(
    index: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", top: int = TOP,
    batch_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Columns query_id, rank, doc_id, score: the ``top`` best documents of every row of ``queries``.

    Equal scores rank by ascending doc_id, null ids last. A null or wordless query, one without
    known terms, or an empty index gives no rows. Equal texts are searched once, and each of their
    rows gets the result. The driver holds ``batch_bytes`` of query text at a time (one
    query, if that is longer); the index is read once per batch.
    """
    spark = index.sparkSession
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{text}`").cast("string").alias("body"))
    asked = asked.where(F.col("body").isNotNull()).withColumn("key", F.sha2("body", 256))
    distinct = materialize(asked.groupBy("key").agg(F.any_value("body").alias("body")), "ranked-queries")
    stats = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    stats = (stats[0] or 0, stats[1] or 0)
    size = distinct.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    n = max(1, -(-int(size) // batch_bytes))
    found, numbers, first = [], [], 0
    for k in range(n):
        batch = distinct.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k).collect()
        if batch:
            hits = _search_batch(index, [r["body"] for r in batch], first, stats, top)
            keys = spark.createDataFrame([(first + i, r["key"]) for i, r in enumerate(batch)], "query long, key string")
            found.append(hits.join(F.broadcast(keys), "query").select("key", "score", "doc_id"))
            first += len(batch)
    if not found:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return asked.select("query_id", "key").join(best, "key").select("query_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    found = search(index, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.withColumnRenamed("query_id", "item_id")


_TERMS = (
    r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('text')} AS w FROM documents),
dn AS (SELECT r, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM dn),
q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS.format('text')}) AS w FROM benchmark
),
qt AS (SELECT q, item_id, unnest(w) AS t FROM q),
tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dn) WHERE t IN (SELECT t FROM qt) GROUP BY r, t
),
wt AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM tf, s GROUP BY t, nn),
part AS (
  SELECT r, t, wt * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) AS v
  FROM tf JOIN dn USING (r) JOIN wt USING (t), s
),
sc AS (SELECT q, item_id, r, sum(v)::BIGINT AS score FROM qt JOIN part USING (t) GROUP BY q, item_id, r),
ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM sc JOIN dn USING (r) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
