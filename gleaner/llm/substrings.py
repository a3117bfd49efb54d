"""Exact removal of repeated byte strings with longest-previous-factor arrays.

A byte goes if it lies in a string of ``length`` bytes that occurs elsewhere, in another
document or the same. Sorting every suffix of a corpus would move each byte hundreds of
times; only the suffixes near repeats need sorting. They are found by *anchors*: in every
string of ``length`` bytes the leftmost ``GRAM``-byte gram with the least hash. Equal strings
have equal anchors, and consecutive strings share one, so a text falls into *runs* of
string starts with one anchor; the *block* of a run is the text that its strings cover.

1. Anchors are counted by gram hash (texts stay, one small row per run moves); an anchor that
   occurs once is done.
2. Runs of repeated anchors are grouped by anchor and block hash. A block that occurs twice is
   repeated throughout and needs no more work: that settles copies and the inside of passages.
3. Anchors with different blocks, at the edges of passages, are resolved exactly: one text of
   each block is fetched and whole anchor groups are put through a suffix order of depth
   ``length``. In it the previous and next smaller positions with a common prefix of ``length``
   give for every string an earlier match, the longest-previous-factor test; the mirrored one
   gives later matches. Groups of over ``GROUP`` blocks, where a passage stands in very many
   surroundings, never meet in a task: their strings are compared by hash in two aggregations.
4. The repeated starts of a text become byte ranges, and a last pass cuts them out.

``keep="first"`` leaves the first occurrence (by smallest document id, then position) of
every string, ``keep="none"`` removes all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleaner.llm.common import blocks, free_name, materialize
from gleaner.llm.neardup import mix
from gleaner.sources.tables import read_table

LENGTH = 400
GRAM = 32
#: Blocks of one anchor that are sorted together in a task.
GROUP = 4096
#: Bytes that are sorted together, and string starts that a large group's first aggregation takes as one.
SORT_BYTES = 1 << 18
STRIDE = 16

_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _hash_windows(b: np.ndarray, width: int) -> np.ndarray:
    """Polynomial 64-bit hash of every ``width``-byte window, by doubling."""
    out, done = None, 0
    piece, size = _BYTE[b], 1
    power = np.full(1, _BASE)  # arrays wrap without a warning
    while size <= width:
        if width & size:
            if out is None:
                out, done = piece, size
            else:
                n = len(b) - done - size + 1
                out = out[:n] * power + piece[done : done + n]
                done += size
        if size * 2 <= width:
            n = len(piece) - size
            piece = piece[:n] * power + piece[size : size + n]
            power = power * power
        size *= 2
    return mix(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


class _Powers:
    """The powers of both bases, kept by a process for texts of up to a million bytes."""

    held = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.held[0]) >= n:
            return cls.held[0][:n], cls.held[1][:n]
        both = _powers(_BASE, n), _powers(_INVERSE, n)
        if n <= 1 << 20:
            cls.held = both
        return both


class Prefix:
    """Hash of any substring of a byte array in constant time."""

    def __init__(self, b: np.ndarray):
        powers, self.inverse = _Powers.of(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * powers[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost value with the least upper half in every window of ``w`` values.

    Upper half and place share a number, so that a minimum takes both; doubling reaches any width in log steps.
    """
    n = len(h) - w + 1
    best, size = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= w:
        best, size = np.minimum(best[: len(best) - size], best[size:]), size * 2
    best = np.minimum(best[:n], best[w - size : w - size + n])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of one text: first start, last start, anchor hash, block hash."""
    if len(text) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    b = np.frombuffer(text, np.uint8)
    gram = min(GRAM, length)
    h = _hash_windows(b, gram)
    anchor = _leftmost_least(h, length - gram + 1)
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first = np.concatenate([[0], edge])
    last = np.concatenate([edge, [len(anchor)]]) - 1
    return first, last, h[anchor[first]].view(np.int64), Prefix(b).of(first, last + length).view(np.int64)


def _run_rows(source: DataFrame, length: int) -> DataFrame:
    """(text_id, s, e, anchor, block): runs of all texts; a task reads copies of a text once."""
    names = ["text_id", "s", "e", "anchor", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part, texts in blocks(batch, "text", 4 << 20):
                for text_id, text in zip(part.column("text_id").to_pylist(), texts):
                    if text_id not in seen:
                        seen.add(text_id)
                        found = runs_of(text, length)
                        ids = pa.array([text_id] * len(found[0]), pa.binary())
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in found)], names=names)

    return source.select("text_id", "text").mapInArrow(run, "text_id binary, s long, e long, anchor long, block long")


def order_to_depth(data: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Class of every position (or of ``starts``) by its next ``depth`` bytes, numbered in suffix order.

    A class is the place of its first suffix in that order. A round joins the classes of as many
    positions, one behind the other, as a number holds (prefix doubling joins two). Positions that
    stand alone are done, and those that no start reaches in later rounds aren't sorted again;
    positions within ``depth`` of the end are classed by what follows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.zeros(256, np.int64)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    symbols[used] = np.arange(1, len(used) + 1)
    bits = int(len(used)).bit_length()
    known = min(depth, 63 // bits)
    key, coded = np.zeros(n, np.int64), symbols[data]
    for i in range(known):
        key <<= bits
        key[: max(0, n - i)] |= coded[i:]
    width = n.bit_length()
    rounds: list[list[int]] = []  # offsets of the classes that a round joins to that of the position
    while known < depth:
        goal = min(depth, known * max(2, 63 // width))
        rounds.append([min(k, goal - known) for k in range(known, goal, known)])
        known = goal
    wanted = np.ones(n, bool)
    if starts is not None:
        wanted[:] = False
        wanted[starts] = True
    needed = [wanted]
    for offsets in reversed(rounds):
        needed.insert(0, needed[0].copy())
        for k in offsets:
            needed[0][k:] |= needed[1][: max(0, n - k)]
    rank, active = np.zeros(n, np.int64), np.flatnonzero(needed[0])
    key = key[active]
    for offsets, later in zip([*rounds, None], [*needed[1:], None]):
        order = np.argsort(key)
        key, active = key[order], active[order]
        place = np.arange(len(active))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[active]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        # the class moves by as many places as its members stand behind the first of their former class
        rank[active] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        if offsets is None:
            break
        alone = fresh & np.concatenate([fresh[1:], [True]])
        active = active[~alone & later[active]]
        if not len(active):
            break
        key = rank[active]
        for k in offsets:
            key = (key << width) | np.where(active + k < n, rank[np.minimum(active + k, n - 1)] + 1, 0)
    return rank


def factors(texts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every string start of every text: does the string occur earlier, does it occur later?

    The texts are concatenated in order; no string starts where it would reach into the next. In
    the suffix order the previous (next) position of the same class to depth ``length`` is the
    nearest earlier (later) match, so the longest previous (next) factor reaches ``length``.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    starts = [np.arange(max(0, s - length + 1)) + (e - s) for s, e in zip(sizes, ends)]
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    rank = order_to_depth(data, length, at)[at]
    order = np.argsort(rank, kind="stable")  # equal classes stay in text order
    same = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    earlier[order[1:]], later[order[:-1]] = same, same
    cuts = np.cumsum([len(s) for s in starts])[:-1]
    return list(zip(np.split(earlier, cuts), np.split(later, cuts)))


def _ranges(flags: np.ndarray) -> list[int]:
    """Flat first, last pairs of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


_RESOLVED = "anchor long, block long, ranges array<int>"


def _by_suffix_order(groups: DataFrame, length: int, first: bool) -> DataFrame:
    """Repeated starts of the blocks of whole anchor groups: (anchor, block, ranges)."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted({(r[0], r[1]): r for r in rows}.values(), key=lambda r: r[2])  # rows repeated whole count once
        found = factors([r[3] for r in rows], length)
        ranges = [_ranges(early if first else early | late) for early, late in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(ranges, pa.list_(pa.int32()))],
            names=["anchor", "block", "ranges"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield resolve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield resolve(held)

    ordered = groups.select("anchor", "block", "place", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, _RESOLVED)


def _by_hash(groups: DataFrame, length: int, first: bool) -> DataFrame:
    """The same for anchors with very many blocks, by two aggregations instead of a sort of a group.

    Blocks are cut into pieces of ``STRIDE`` starts, counted from the anchor. What all strings
    of a piece share must occur twice, else none of them does; if the whole piece occurs twice,
    all of them do. Only the strings of the pieces in between are counted one by one.
    """

    stride = max(1, min(STRIDE, length // 2))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, block, place, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                b = np.frombuffer(data, np.uint8)
                n = len(b) - length + 1
                h = _hash_windows(b, min(GRAM, length))
                at = int(_leftmost_least(h, length - min(GRAM, length) + 1)[0])
                cut = np.unique(np.concatenate([[0], np.arange(at % stride, n, stride), [n]]))
                lo, hi = cut[:-1], cut[1:]
                prefix = Prefix(b)
                cell = at + (lo - at) // stride * stride  # a run may end inside a piece; what is shared is that of the whole piece
                shared = prefix.of(cell + stride - 1, cell + length).view(np.int64)
                whole = prefix.of(lo, hi - 1 + length).view(np.int64)
                every = prefix.of(np.arange(n), np.arange(n) + length).view(np.int64)
                m = len(lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([anchor] * m, pa.int64()), pa.array([block] * m, pa.int64()), pa.array([place] * m, pa.string()),
                     pa.array(lo), pa.array(shared), pa.array(whole), pa.array([every[a:z].tolist() for a, z in zip(lo, hi)], pa.list_(pa.int64()))],
                    names=["anchor", "block", "place", "lo", "shared", "whole", "every"],
                )

    rows = groups.select("anchor", "block", "place", "bytes").mapInArrow(
        pieces, "anchor long, block long, place string, lo long, shared long, whole long, every array<bigint>"
    ).dropDuplicates(["anchor", "block", "lo"])
    rows = materialize(rows, "pieces")
    me = F.struct("place", "block")
    shared = rows.groupBy("anchor", "shared").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "shared")
    alike = rows.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(me).alias("head"))
    rows = rows.join(shared, ["anchor", "shared"], "left_semi").join(alike, ["anchor", "whole"])
    settled = rows.where((F.col("n") > 1) & (me != F.col("head") if first else F.lit(True)))
    settled = settled.select("anchor", "block", F.sequence("lo", F.col("lo") + F.size("every") - 1).alias("at"))
    # Of equal pieces the first one goes on, for the others that it meets.
    strings = rows.where(me == F.col("head")).select("anchor", "block", "place", "lo", F.posexplode("every").alias("i", "h"))
    seen = strings.groupBy("anchor", "h").agg(F.count("*").alias("n"), F.min(me).alias("head")).where("n > 1")
    hit = strings.join(seen.select("anchor", "h", "head"), ["anchor", "h"])
    if first:
        hit = hit.where(me != F.col("head"))
    hit = hit.groupBy("anchor", "block").agg(F.collect_list(F.col("lo") + F.col("i")).alias("at"))
    both = settled.groupBy("anchor", "block").agg(F.flatten(F.collect_list("at")).alias("at")).unionByName(hit)
    starts = both.groupBy("anchor", "block").agg(F.flatten(F.collect_list("at")).alias("at"))  # at most the starts of one run
    return starts.select("anchor", "block", F.flatten(F.transform("at", lambda x: F.array(x.cast("int"), x.cast("int")))).alias("ranges"))


def _cut(texts: list, ranges: list) -> list:
    """n_bytes, n_removed, n_spans, kept bytes of each text without its byte ranges."""
    out = []
    for text, found in zip(texts, ranges):
        text = text or b""
        spans = []
        for a, z in sorted(zip(found[0::2], found[1::2])) if found else ():
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], z)
            else:
                spans.append([a, z])
        kept, at = [], 0
        for a, z in spans:
            kept.append(text[at:a])
            at = z
        kept.append(text[at:])
        out.append((len(text), sum(z - a for a, z in spans), len(spans), b"".join(kept)))
    return out


CUT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
])


def deduplicate(
    docs: DataFrame, result: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "none",
    columns: list[str] | None = None, group: int = GROUP, with_text: bool = True,
) -> DataFrame:
    """Columns ``columns`` (default: all) of ``docs`` with a struct ``result``: n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` is what remains, as bytes (a cut may split a character); null if not ``with_text``.
    A null text is empty; texts under ``length`` bytes stay whole. Rows repeated with one id are
    copies of each other like any others; with ``keep="first"`` the rows of the smallest id stay.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    kept = docs.columns if columns is None else columns
    first = keep == "first"
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    source = source.where(F.octet_length("text") >= length).withColumn("text_id", F.unhex(F.md5("text")))
    texts = materialize(source.groupBy("text_id").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "texts")

    # Anchors are found once: a row per run costs less to keep than to find again.
    rows = materialize(_run_rows(source, length), "rows")
    # Copies of a text in several tasks count repeatedly, which only makes more anchors pass.
    anchors = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("x"), F.max("block").alias("y")).where("n > 1")
    anchors = materialize(anchors.select("anchor", (F.col("x") != F.col("y")).alias("mixed")), "anchors")
    runs = rows.join(anchors, "anchor").dropDuplicates(["text_id", "s"])
    runs = runs.join(texts.select("text_id", "first_id", "copies"), "text_id")
    # The order of occurrences, as text: smallest id of the text, digest, start.
    sign = F.when(F.col("first_id").isNull(), "0").otherwise("1")
    padded = F.lpad(F.hex(F.expr("first_id ^ shiftleft(1L, 63)")), 16, "0")
    place = F.concat(sign, F.coalesce(padded, F.lit("")), F.hex("text_id"), F.lpad(F.hex("s"), 16, "0"))
    runs = materialize(runs.select("text_id", "first_id", "copies", "s", "e", "anchor", "block", "mixed", place.alias("place")), "runs")

    stats = runs.groupBy("anchor", "block").agg(
        F.sum("copies").alias("n"), F.min(F.struct("place", "text_id", "first_id", "s", "e")).alias("head"), F.max("mixed").alias("mixed"),
    )
    stats = materialize(stats, "blocks")
    mixed = stats.where("mixed").select("anchor", "block", "head.*")
    wanted = mixed.groupBy("text_id", "first_id").agg(F.collect_list(F.struct("s", "e", "anchor", "block", "place")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, contents in blocks(batch, "text", 4 << 20):
                out = [
                    (w["anchor"], w["block"], w["place"], data[w["s"] : w["e"] + length])
                    for data, want in zip(contents, part.column("want").to_pylist()) for w in want
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                    names=["anchor", "block", "place", "bytes"],
                )

    told = source.join(wanted.withColumnRenamed("text_id", "w"), (F.col("text_id") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    fetched = materialize(told.select("text", "want").mapInArrow(fetch, "anchor long, block long, place string, bytes binary"), "fetched")
    sizes = materialize(stats.where("mixed").groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > group), "large")
    ordinary = _by_suffix_order(fetched.join(sizes, "anchor", "left_anti"), length, first)
    large = _by_hash(fetched.join(sizes, "anchor", "left_semi"), length, first)
    resolved = ordinary.unionByName(large)

    known = stats.join(resolved, ["anchor", "block"], "left").select("anchor", "block", "n", F.col("head.place").alias("head"), "ranges")
    all_starts = F.array(F.lit(0), (F.col("e") - F.col("s")).cast("int"))
    none = F.array().cast("array<int>")
    if first:
        own = F.when(F.col("place") == F.col("head"), F.coalesce("ranges", none)).otherwise(all_starts)
    else:
        own = F.when(F.col("n") > 1, all_starts).otherwise(F.coalesce("ranges", none))
    # first and last repeated start of a run, to the bytes that those strings cover
    to_bytes = F.transform(own, lambda x, i: (x + F.col("s") + F.when(i % 2 == 1, length).otherwise(0)).cast("int"))
    by_text = runs.join(known, ["anchor", "block"]).select("text_id", to_bytes.alias("r")).where(F.size("r") > 0)
    by_text = by_text.groupBy("text_id").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    by_text = materialize(by_text, "ranges")
    marks = texts.join(by_text, "text_id", "left").where("copies > 1 or ranges is not null")

    t_in, r_in, k_in, f_in = (free_name(docs, x) for x in ("copies_in", "ranges_in", "key_in", "first_in"))
    marks = marks.select(F.col("text_id").alias(k_in), F.col("first_id").alias(f_in), F.col("copies").alias(t_in), F.col("ranges").alias(r_in))
    whole = F.array(F.lit(0), F.octet_length(F.col(f"`{text}`").cast("string")))
    joined = docs.join(marks, F.unhex(F.md5(F.col(f"`{text}`").cast("string"))) == F.col(k_in), "left")
    # Copies of a text go whole; to keep the first, those of its smallest id don't.
    copy = F.col(t_in) > 1
    if first:
        copy = copy & ~F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(f_in))
    ranges = F.when(copy, whole).otherwise(F.coalesce(F.col(r_in), none))
    body = free_name(docs, "body_in")
    out_schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(result, CUT)])
    joined = joined.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(body), ranges.alias(r_in))
    return _apply(joined, body, r_in, kept, out_schema, with_text)


def _apply(df: DataFrame, body: str, ranges: str, kept: list[str], schema: T.StructType, with_text: bool) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in blocks(batch, body):
                found = _cut(texts, part.column(len(kept) + 1).to_pylist())
                struct = pa.StructArray.from_arrays(
                    [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
                    + [pa.array([hashlib.sha256(f[3]).hexdigest() for f in found], pa.string()),
                       pa.array([f[3] if with_text else None for f in found], pa.binary())],
                    fields=list(arrow.field(len(kept)).type),
                )
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), struct], names=arrow.names)

    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    cut = deduplicate(docs, "cut", columns=["doc_id"])
    # What remains stands beside its digest; only in a text whose cuts split a character do the two differ.
    remains = F.make_valid_utf8(F.col("cut.kept").cast("string")).alias("text")
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256", remains)
