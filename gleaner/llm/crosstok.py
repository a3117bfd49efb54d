"""Cross-tokenizer alignment: which tokens of A and B share bytes, and in how many documents.

**Alignment.** Both tokenizers end a token wherever a space follows a character that isn't white
space: A by its splitting rule, B because no piece has a space mark behind another character
(checked when the model is loaded). Texts are therefore encoded in *chunks* cut at these places. A task encodes
a chunk once while its bounded memory holds it; byte offsets where tokens of both end cut a
chunk into groups, and all A-B pairs of occurrences within a group are links.

**Index.** Documents get ordinals in *blocks* of a task. Per pair and block one row holds the
documents with a link of that pair as a compressed bitmap (two bytes per document, or one bit per
ordinal where that is shorter) and *multiplicity planes*: plane k has the documents whose number of
links less one has bit k. A task makes bitmaps per batch of text and OR-merges them when the block is
closed. Popcounts give documents and links of the row; their sums per pair are plain sums, so no
pair is gathered anywhere: a pair of every document has one small row per block.

**Scores.** Pair rows join their corpus-wide count and whether it is the highest of its A id; then
they move to their block, where the bitmaps (postings) return to every document what its links add.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import blocks, materialize
from gleaner.sources.tables import read_table

#: Folder of the vocabulary files on every machine, and the files of A and B.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A block is closed at so many documents or postings.
BLOCK_DOCS = 1 << 14
BLOCK_POSTINGS = 1 << 23
#: A task forgets its encoded chunks beyond so many, or so many characters of them.
MEMORY, MEMORY_CHARS = 1 << 19, 1 << 26
#: Characters of chunks that are encoded in one call; token pairs of a group beyond which ids are counted first.
_JOINED, _LARGE = 1 << 14, 1 << 12

#: From a place where a space follows a character that isn't white space to the next such place.
CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+")
_CUT = re.compile(r"\S(?= )")
_PIECE = 1 << 20


class Tokenizers:
    """A and B with the bytes of their tokens."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        symbols = byte_symbols()
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(symbols[c] for c in name) if all(c in symbols for c in name) else name.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            if "▁" in name.lstrip("▁"):
                raise ValueError(f"piece {name!r} spans words: chunks can't be encoded one by one")
            self.bytes_b.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())

        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        #: Ids as text with the separator behind them: A within and at the end of a group, then B.
        self.names = [f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(n)]
        self.name_sizes = np.array([len(x) for x in self.names], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Token ids of A and B per text (which begins with a space); None if their bytes aren't the text's."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        out = []
        for text, a, b in zip(texts, ids_a, ids_b, strict=True):
            raw = text.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])
            out.append((a, b) if same else None)
        return out

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat token ids of A and B over all chunks that they spell, and whether a chunk is one of these.

        Chunks are encoded joined, which gives the same tokens; one that ends in white space, as
        the end of a text may, goes alone, and so do those of a joined text that isn't spelled.
        """
        joined, now, size = [], [], 0
        for i, chunk in enumerate(chunks):
            alone = chunk[-1].isspace()
            if now and (alone or size > _JOINED):
                joined.append(now)
                now, size = [], 0
            now.append(i)
            size += len(chunk)
            if alone:
                joined.append(now)
                now, size = [], 0
        joined += [now] if now else []
        good = np.ones(len(chunks), bool)
        ids: list[tuple[list[int], list[int]]] = []
        for group, made in zip(joined, self.encode(["".join([chunks[i] for i in g]) for g in joined]), strict=True):
            if made:
                ids.append(made)
                continue
            single = self.encode([chunks[i] for i in group])
            good[[i for i, x in zip(group, single, strict=True) if x is None]] = False
            ids += [x for x in single if x]
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in ids), np.int64) for k in (0, 1))
        return a, b, good


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def slices(text: str, size: int) -> Iterator[str]:
    """The text in slices of about ``size`` characters that end where a chunk ends."""
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class Chunks:
    """Encoded chunks with their groups and pairs, in arrays by number."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.width = tokenizers, len(tokenizers.bytes_b)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.names: list[str] = []  # groups as text, each with a semicolon behind it
        self.sums = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, unequal bytes
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)
        self.chars = 0

    def numbers(self, text: str) -> np.ndarray:
        found = []
        for part in slices(text, _PIECE):
            chunks = CHUNK.findall(part)
            found.append(np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks)))
        return found[0] if len(found) == 1 else np.concatenate(found)

    def learn(self) -> None:
        """Encode the chunks that are new and cut them into groups."""
        fresh = list(islice(self.number, len(self.names), None))
        if not fresh:
            return
        made = self.tokenizers
        a, b, good = made.encode_chunks(fresh)
        sizes = np.fromiter((len(c.encode()) for c, g in zip(fresh, good, strict=True) if g), np.int64)
        ends_a, ends_b, chunk_ends = np.cumsum(made.sizes_a[a]), np.cumsum(made.sizes_b[b]), np.cumsum(sizes)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        chunk = np.flatnonzero(good)[np.searchsorted(chunk_ends, common)]  # of each group
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        where, pairs, times = self._links(a, b, n_a, n_b)
        n = len(fresh)
        count = lambda weights: np.bincount(chunk, weights, n).astype(np.int64)
        self.sums = np.concatenate([self.sums, np.stack([count(n_a), count(n_b), np.bincount(chunk, minlength=n), count(n_a * n_b), ~good], 1)])
        self.ends = np.concatenate([self.ends, len(self.pairs) + np.cumsum(np.bincount(chunk[where], minlength=n))])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        # The text of all groups: A ids, then B ids, each with its separator.
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        codes = np.empty(len(a) + len(b), np.int64)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        width_a, width_b = len(made.bytes_a), len(made.bytes_b)
        codes[np.arange(len(a)) + (last_b + 1 - n_b)[group_a]] = a + end_a * width_a
        codes[np.arange(len(b)) + (last_a + 1)[group_b]] = b + 2 * width_a + end_b * width_b
        text = "".join(map(made.names.__getitem__, codes.tolist()))
        chars = np.bincount(np.repeat(chunk, n_a + n_b), made.name_sizes[codes], n).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(chars)]).tolist()
        self.names += [text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        self.chars += sum(map(len, fresh)) + len(text)

    def _links(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, pair and number of links, in order of groups. Groups of many tokens are counted by id."""
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        large = n_a * n_b > _LARGE
        size = np.where(large, 0, n_a * n_b)
        where = np.repeat(np.arange(len(n_a)), size)
        inside = np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
        pairs = a[first_a[where] + inside // n_b[where]] * self.width + b[first_b[where] + inside % n_b[where]]
        times = np.ones(len(pairs), np.int64)
        if large.any():
            parts = [(where, pairs, times)]
            for g in np.flatnonzero(large):
                x, n = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
                y, m = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
                parts.append((np.full(len(x) * len(y), g), (x[:, None] * self.width + y).ravel(), (n[:, None] * m).ravel()))
            where, pairs, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(where, kind="stable")
            where, pairs, times = where[order], pairs[order], times[order]
        return where, pairs, times

    def full(self) -> bool:
        return len(self.names) > MEMORY or self.chars > MEMORY_CHARS

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of these chunks and their links."""
        which, copies = np.unique(numbers, return_counts=True)
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        pairs, times = self.pairs[at], self.times[at] * np.repeat(copies, size)
        order = np.argsort(pairs)
        pairs, times = pairs[order], times[order]
        first = np.flatnonzero(_starts(pairs))
        return pairs[first], np.add.reduceat(times, first) if len(first) else times

    def digest(self, numbers: np.ndarray) -> str:
        made, name = hashlib.sha256(), self.names.__getitem__
        for k in range(0, len(numbers), _PIECE):
            part = "".join(map(name, numbers[k : k + _PIECE].tolist()))
            made.update((part if k + _PIECE < len(numbers) else part[:-1]).encode())
        return made.hexdigest()


class Bitmaps:
    """Compressed bitmaps over ordinals below ``span``: offsets and bytes.

    A bitmap of fewer than ``span`` / 16 ordinals is their sorted list of two bytes each, a denser one
    has a bit per ordinal; the length tells which.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, span: int):
        self.offsets, self.data, self.span = offsets, data, span

    @classmethod
    def make(cls, slots: np.ndarray, ordinals: np.ndarray, n: int, span: int) -> Bitmaps:
        """Bitmap ``slots[i]`` has ``ordinals[i]``; both sorted, without repeats."""
        count = np.bincount(slots, minlength=n)
        dense = count * 16 >= span
        size = np.where(dense, span // 8, 2 * count)
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = np.zeros(offsets[-1], np.uint8)
        thick = dense[slots]
        rank = np.arange(len(slots)) - np.repeat(np.cumsum(count) - count, count)
        at, value = (offsets[slots] + 2 * rank)[~thick], ordinals[~thick]
        data[at], data[at + 1] = value & 255, value >> 8
        at, value = offsets[slots[thick]], ordinals[thick]
        np.bitwise_or.at(data, at + (value >> 3), (1 << (value & 7)).astype(np.uint8))
        return cls(offsets, data, span)

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """Slots and ordinals of all bits, in order of slot and ordinal."""
        size = np.diff(self.offsets)
        dense = size == self.span // 8
        inside = np.repeat(dense, size)
        ordinals = self.data[~inside].view("<u2").astype(np.int64)
        slots = np.repeat(np.flatnonzero(~dense), size[~dense] // 2)
        if dense.any():
            rows, bits = np.nonzero(np.unpackbits(self.data[inside].reshape(-1, self.span // 8), axis=1, bitorder="little"))
            slots = np.concatenate([slots, np.flatnonzero(dense)[rows]])
            ordinals = np.concatenate([ordinals, bits])
            order = np.argsort(slots, kind="stable")
            slots, ordinals = slots[order], ordinals[order]
        return slots, ordinals

    def popcount(self) -> np.ndarray:
        size = np.diff(self.offsets)
        bits = np.concatenate([[0], np.cumsum(np.bitwise_count(self.data), dtype=np.int64)])
        return np.where(size == self.span // 8, bits[self.offsets[1:]] - bits[self.offsets[:-1]], size // 2)

    def to_arrow(self) -> pa.Array:
        offsets = pa.py_buffer(self.offsets.astype(np.int32).tobytes())
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.offsets) - 1, [None, offsets, pa.py_buffer(self.data.tobytes())])

    @classmethod
    def from_arrow(cls, array: pa.Array, span: int) -> Bitmaps:
        array = array.cast(pa.large_binary())
        if not len(array):
            return cls(np.zeros(1, np.int64), np.zeros(0, np.uint8), span)
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        return cls(offsets - offsets[0], data, span)


def _starts(values: np.ndarray) -> np.ndarray:
    """Whether a sorted value differs from the one before."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of sorted values, and the place of each value among them."""
    new = _starts(values)
    return values[new], np.cumsum(new) - 1


def or_merge(parts: list[tuple[np.ndarray, Bitmaps]]) -> tuple[np.ndarray, Bitmaps]:
    """Keys (sorted) and the OR of their bitmaps."""
    if len(parts) == 1:
        return parts[0]
    span = parts[0][1].span
    members = [(keys[slots], ordinals) for keys, bitmaps in parts for slots, ordinals in [bitmaps.members()]]
    both = np.sort(np.concatenate([k for k, _ in members]) * span + np.concatenate([o for _, o in members]))
    both = both[_starts(both)]
    keys, slots = _numbered(both // span)
    return keys, Bitmaps.make(slots, both % span, len(keys), span)


#: A pair's planes are keyed by pair * PLANES + plane: the documents first, then the bits of links - 1.
PLANES = 64

INDEX = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()),
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("a", T.IntegerType()),
    T.StructField("b", T.IntegerType()),
    T.StructField("pair_docs", T.LongType()),
    T.StructField("pair_links", T.LongType()),
    T.StructField("docs", T.BinaryType()),
    T.StructField("planes", T.ArrayType(T.BinaryType())),
])
_TYPES = [
    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(),
    pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()),
]


class Block:
    """Documents with ordinals and the bitmaps of their pairs."""

    def __init__(self, span: int, width: int):
        self.span, self.width = span, width
        self.rows: list[tuple] = []
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.parts: list[tuple[np.ndarray, Bitmaps]] = []
        self.postings = 0

    def add(self, row: tuple, pairs: np.ndarray, links: np.ndarray) -> None:
        self.fresh.append((pairs, links, np.full(len(pairs), len(self.rows))))
        self.rows.append(row)
        self.postings += len(pairs)

    def compress(self) -> None:
        """Bitmaps of the documents since the last call."""
        if not self.fresh:
            return
        pairs, links, ordinals = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
        self.fresh = []
        keys, bits, extra, plane = [pairs * PLANES], [ordinals], links - 1, 1
        while extra.any():
            odd = (extra & 1) == 1
            keys.append(pairs[odd] * PLANES + plane)
            bits.append(ordinals[odd])
            pairs, ordinals, extra = pairs[extra > 1], ordinals[extra > 1], extra[extra > 1] >> 1
            plane += 1
        keys, bits = np.concatenate(keys), np.concatenate(bits)
        both = np.sort(keys * self.span + bits)
        found, slots = _numbered(both // self.span)
        self.parts.append((found, Bitmaps.make(slots, both % self.span, len(found), self.span)))

    def full(self, postings: int) -> bool:
        return len(self.rows) >= self.span or self.postings >= postings

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        n = len(self.rows)
        columns = list(zip(*self.rows, strict=True))
        yield _batch(n, [np.full(n, number), np.arange(n, dtype=np.int32), *columns])
        self.compress()
        keys, bitmaps = or_merge(self.parts)
        if not len(keys):
            return
        pairs, plane = keys // PLANES, keys % PLANES
        head = np.flatnonzero(plane == 0)
        count = bitmaps.popcount()
        weighted = np.where(plane == 0, count, count << np.maximum(plane - 1, 0))
        planes = np.append(plane[head[1:] - 1], plane[-1])  # the highest plane of each pair
        slot = np.cumsum(planes) - planes  # empty planes below the highest one have a place, too
        first = Bitmaps(bitmaps.offsets, bitmaps.data, self.span)
        slots, ordinals = first.members()
        is_head = plane[slots] == 0
        row_of = np.cumsum(plane == 0) - 1
        docs = Bitmaps.make(row_of[slots[is_head]], ordinals[is_head], len(head), self.span)
        upper = slots[~is_head]
        deep = Bitmaps.make(slot[row_of[upper]] + plane[upper] - 1, ordinals[~is_head], int(planes.sum()), self.span)
        nested = pa.ListArray.from_arrays(pa.array(np.append(slot, planes.sum()).astype(np.int32)), deep.to_arrow())
        k = len(head)
        yield _batch(k, [
            np.full(k, number), *[None] * 7, (pairs[head] // self.width).astype(np.int32), (pairs[head] % self.width).astype(np.int32),
            count[head], np.add.reduceat(weighted, head), docs.to_arrow(), nested,
        ])


def _batch(n: int, columns: list) -> pa.RecordBatch:
    columns = [*columns, *[None] * (len(_TYPES) - len(columns))]
    made = [
        pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t)
        for c, t in zip(columns, _TYPES, strict=True)
    ]
    return pa.RecordBatch.from_arrays(made, names=INDEX.names)


def build_index(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, block_docs: int = BLOCK_DOCS,
    block_postings: int = BLOCK_POSTINGS,
) -> DataFrame:
    """Rows of documents (``ordinal`` is set) and of pairs (``a``, ``b`` are set) per block, as a table.

    Every row of ``docs`` is a document, repeated rows and ids too; ids are cast to long and may be
    null. A text that is null, empty, no valid UTF-8, or whose tokens of A or B don't spell it (white
    space marks in it, for example) has no tokens: zeros and an empty ``groups_sha256``. Long texts
    are cut into slices for encoding, never for the result. An empty table gives an empty index.
    Further columns of ``docs`` are not read.
    """
    if block_docs % 16 or not 0 < block_docs <= 1 << 16:
        raise ValueError("blocks hold a multiple of 16 documents, 65536 at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(Tokenizers(f"{folder}/{FILE_A}", f"{folder}/{FILE_B}"))
        task, number, block = TaskContext.get().partitionId(), 0, Block(block_docs, chunks.width)
        nothing = np.zeros(0, np.int64)
        for batch in batches:
            for part, texts in blocks(batch, "t"):
                found = [chunks.numbers(" " + t) if t else None for t in map(_decoded, texts)]
                chunks.learn()
                for i, numbers in zip(part.column("i").to_pylist(), found, strict=True):
                    sums = chunks.sums[numbers].sum(axis=0) if numbers is not None else (0, 0, 0, 0, 1)
                    if sums[4]:
                        block.add((i, 0, 0, 0, 0, ""), nothing, nothing)
                    else:
                        block.add((i, *map(int, sums[:4]), chunks.digest(numbers)), *chunks.links(numbers))
                    if block.full(block_postings):
                        yield from block.batches(task << 32 | number)
                        number, block = number + 1, Block(block_docs, chunks.width)
                block.compress()
                if chunks.full():
                    chunks.clear()
        if block.rows:
            yield from block.batches(task << 32 | number)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return materialize(rows.mapInArrow(run, INDEX), "crosstok-index")


def _decoded(text: bytes | None) -> str | None:
    try:
        return text.decode() if text else None
    except UnicodeDecodeError:
        return None


def pairs(index: DataFrame) -> DataFrame:
    """Columns a, b, n_docs, n_links, best: every linked pair of ids, its documents and links, and whether
    no other B id shares more documents with this A id."""
    counts = index.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum("pair_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("highest")).alias("best"))


SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SCORES = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def scores(index: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per document: its tokens, groups and links, ``n_best`` (links of a best pair) and
    ``count_sum`` (documents of the pair, summed over links). ``block_docs`` as for the index."""

    def give(_key: tuple, documents: pa.Table, postings: pa.Table) -> pa.Table:
        total = np.zeros((documents.num_rows, 2), np.int64)
        for part in postings.combine_chunks().to_batches(max_chunksize=1 << 17):
            value = np.stack([part.column("best").cast(pa.int64()).to_numpy(), part.column("pair_count").to_numpy()], 1)
            _return(total, value, Bitmaps.from_arrow(part.column("docs"), block_docs))
            planes = part.column("planes")
            size = planes.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            level = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            _return(total, value[row] << level[:, None], Bitmaps.from_arrow(planes.flatten(), block_docs))
        order = documents.column("ordinal").to_numpy()
        columns = {c: documents.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array(total[order, 0]), "count_sum": pa.array(total[order, 1])}
        return pa.table([columns[c] for c in _SCORES.names], schema=_SCORES)

    known = pairs(index).select("a", "b", F.col("n_docs").alias("pair_count"), "best")
    postings = index.where("a IS NOT NULL").select("block", "a", "b", "docs", "planes").join(known, ["a", "b"])
    documents = index.where("ordinal IS NOT NULL").select(
        F.col("block").alias("home"), "ordinal", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
    )
    postings = postings.select(F.col("block").alias("target"), "docs", "planes", "pair_count", "best")
    return documents.groupBy("home").cogroup(postings.groupBy("target")).applyInArrow(give, SCORES)


def _return(total: np.ndarray, value: np.ndarray, bitmaps: Bitmaps) -> None:
    """Add the value of each bitmap to its documents."""
    slots, ordinals = bitmaps.members()
    np.add.at(total, ordinals, value[slots])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(build_index(read_table(spark, sf_dir, "documents", "doc_id", "text")))
