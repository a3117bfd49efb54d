"""Language identification: script ranges, per-word scores, Viterbi over mixed-language text.

A text is lower-cased and cut into words (runs of anything but ASCII non-letters). The
*script* of a word, from code point ranges, narrows its candidate languages to those that
were seen in that script while learning. Every candidate gets the word's score: the sum of
the log likelihood ratios of its byte trigrams, the blank on either side included. *Viterbi*
with a switching penalty then labels the words, so a text of several languages falls into
spans instead of being averaged.

Learning needs only counts: trigrams by language over a bounded sample of the labelled
documents, gathered by an ordinary aggregation. The model is a table of ``2 ** BITS`` rows
and one column per language, so its size doesn't depend on the corpus. Prediction runs
inside the rows over whole texts; words of a batch are scored with array operations and
Viterbi advances many documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import annotate, blocks, free_name
from gleaner.sources.tables import read_table

UNKNOWN = "und"
BITS = 16
#: Expected number of sampled documents per language that the model is fitted on.
FIT_DOCS = 8000
#: Cost in nats of changing the language between two words.
SWITCH = 8.0
#: A trigram speaks for or against a language by at most so many nats.
CLIP = 4.0
#: A script belongs to a language if it holds at least this share of its words.
SCRIPT_SHARE = 0.005
CELLS = 1 << 20  # words times documents of one Viterbi block

# Scripts by code point ranges (first, last); anything else counts as Latin.
SCRIPTS = {
    "greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x0400, 0x052F),),
    "armenian": ((0x0530, 0x058F),),
    "hebrew": ((0x0590, 0x05FF),),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "devanagari": ((0x0900, 0x097F),),
    "bengali": ((0x0980, 0x09FF),),
    "tamil": ((0x0B80, 0x0BFF),),
    "thai": ((0x0E00, 0x0E7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}

RESULT = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("lang", T.StringType()),
    ]))),
])

_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")
_BLANKED = bytes(b if b >= 0x80 or b in _LETTERS else 0x20 for b in range(256))


def _script_of_lead() -> np.ndarray:
    """Script number by the two leading UTF-8 bytes (three-byte ranges meet at this grain)."""
    table = np.zeros(1 << 16, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            for code in range(first, last + 1):
                lead = chr(code).encode()[:2]
                table[lead[0] << 8 | lead[1]] = number
    return table


SCRIPT_OF_LEAD = _script_of_lead()


class Words:
    """The words of a list of texts in one byte buffer."""

    def __init__(self, texts: list):
        parts = [(t or b"").decode("utf-8", "replace").lower().encode().translate(_BLANKED) for t in texts]
        sizes = np.fromiter((len(p) + 2 for p in parts), np.int64, len(parts))
        self.buffer = buffer = np.frombuffer(b" " + b" ".join(p + b" " for p in parts) + b" ", np.uint8)
        inside = buffer != 0x20
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        has_letter = np.ones(len(self.start), bool)
        plain = np.zeros(len(buffer) + 1, np.int32)
        np.cumsum((buffer < 0x80) & inside, out=plain[1:])
        for i in np.flatnonzero(plain[self.end] == plain[self.start]):
            word = buffer[self.start[i] : self.end[i]].tobytes().decode(errors="ignore")
            has_letter[i] = any(ch.isalpha() for ch in word)
        self.start, self.end = self.start[has_letter], self.end[has_letter]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.start, bounds)  # of each text; one more at the end

    def grams(self) -> np.ndarray:
        """Hashed trigram around every byte."""
        b = self.buffer.astype(np.uint32)
        mixed = np.zeros(len(b), np.uint32)
        mixed[1:-1] = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)
        return mixed >> np.uint32(32 - BITS)

    def scripts(self) -> np.ndarray:
        """Script number of each word, by its first non-ASCII letters of a known script."""
        b = self.buffer
        lead = np.zeros(len(b), np.uint8)
        high = np.flatnonzero(b[:-1] >= 0xC0)
        lead[high] = SCRIPT_OF_LEAD[(b[high].astype(np.int32) << 8) | b[high + 1]]
        if not len(self.start):
            return np.zeros(0, np.uint8)
        if not lead.any():
            return np.zeros(len(self.start), np.uint8)
        most = np.maximum.reduceat(lead, np.stack([self.start, self.end], 1).ravel())[::2]
        return most


def counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, key, n): trigram and script counts of a labelled table, summed in Spark."""
    source, label = free_name(df, "t_in"), free_name(df, "l_in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, texts in blocks(batch, source, 4 << 20):
                langs = np.array(part.column(label).to_pylist(), dtype=object)
                for name in sorted(set(langs)):
                    words = Words([t for t, x in zip(texts, langs) if x == name])
                    if name not in sums:
                        sums[name] = np.zeros(1 << BITS, np.int64), np.zeros(256, np.int64)
                    grams = words.grams()
                    sums[name][0][:] += np.bincount(grams[words.buffer != 0x20], minlength=1 << BITS)
                    sums[name][1][:] += np.bincount(words.scripts(), minlength=256)
        for name, both in sums.items():
            for kind, found in enumerate(both):
                key = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(key), pa.string()), pa.array(np.full(len(key), kind, np.int32)),
                     pa.array(key.astype(np.int32)), pa.array(found[key])],
                    names=["lang", "kind", "key", "n"],
                )

    picked = df.select(F.col(f"`{text}`").cast("string").alias(source), F.col(f"`{lang}`").alias(label))
    rows = picked.where(F.col(label).isNotNull()).mapInArrow(run, "lang string, kind int, key int, n long")
    return rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihood ratios (trigram, language) and the languages of each script."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        place = {name: i for i, name in enumerate(self.langs)}
        grams = np.zeros((1 << BITS, len(self.langs)))
        scripts = np.zeros((256, len(self.langs)))
        for name, kind, key, n in rows:
            (scripts if kind else grams)[key, place[name]] = n
        self.prior = scripts.sum(0)
        share = (grams + 0.5) / (grams.sum(0) + 0.5 * (1 << BITS))
        ratio = np.log(share) - np.log(share.mean(1, keepdims=True)) if self.langs else share
        self.ratio = np.clip(ratio, -CLIP, CLIP).astype(np.float32)
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, languages) scores; languages outside the script of a word are far down."""
        if not len(words.start):
            return np.zeros((0, len(self.langs)), np.float32)
        grams = words.grams()
        spans = np.stack([words.start, words.end], 1).ravel()
        out = np.empty((len(words.start), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            out[:, i] = np.add.reduceat(self.ratio[:, i][grams], spans)[::2]
        allowed = self.allowed[words.scripts()]
        out[~allowed & allowed.any(1, keepdims=True)] -= 1e4
        return out

    def label(self, words: Words, switch: float) -> np.ndarray:
        """Best language number of each word, per text, by Viterbi."""
        scores, first = self.word_scores(words), words.first
        lengths = np.diff(first)
        out = np.zeros(len(scores), np.int16)
        order = np.argsort(lengths, kind="stable")[::-1]
        at = 0
        while at < len(order) and lengths[order[at]] > 0:
            longest = int(lengths[order[at]])
            group = order[at : at + max(1, CELLS // longest)]
            group = group[lengths[group] > 0]
            at += len(group)
            _viterbi(scores, first[group], lengths[group], switch, out)
        return out


def _viterbi(scores: np.ndarray, first: np.ndarray, lengths: np.ndarray, switch: float, out: np.ndarray) -> None:
    """Labels of a block of texts, longest first; texts leave the front as they end."""
    n, longest = len(first), int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    back = np.empty((longest, n, scores.shape[1]), np.int16) if longest else None
    state = np.zeros((n, scores.shape[1]), np.float32)
    same = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        k = alive[t]
        old = state[:k]
        if t:
            best = old.argmax(1)
            top = old[np.arange(k), best] - np.float32(switch)
            change = top[:, None] > old
            back[t, :k] = np.where(change, best[:, None], same)
            old = np.where(change, top[:, None], old)
        state[:k] = old + scores[first[:k] + t]
    now = np.zeros(n, np.int64)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        fresh = alive[t + 1] if t + 1 < longest else 0
        now[fresh:k] = state[fresh:k].argmax(1)
        out[first[:k] + t] = now[:k]
        if t:
            now[:k] = back[t, np.arange(k), now[:k]]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from the labelled rows of ``docs``, about ``fit_docs`` of each language.

    The sample is drawn by a hash of ``key`` (default: the text) at the rate that gives the
    expected size. Rows without a language or without text teach nothing. The driver receives
    the summed counts: at most ``2 ** BITS`` rows per language.
    """
    code = F.pmod(F.xxhash64(F.lit("fit"), F.xxhash64(F.col(f"`{text}`")) if key is None else key), F.lit(1_000_000))
    label = F.col(f"`{lang}`")
    sizes = docs.where(label.isNotNull()).groupBy(label.alias("l")).count().collect()
    rate = F.lit(0)
    for name, n in sizes:
        rate = F.when(label == name, min(1_000_000, 1_000_000 * fit_docs // n)).otherwise(rate)
    sample = docs.where(label.isNotNull() & (code < rate))
    return Model([tuple(r) for r in counts(sample, text, lang).collect()])


def identify(
    docs: DataFrame, model: Model, result: str, text: str = "text", switch: float = SWITCH, keep: list[str] | None = None
) -> DataFrame:
    """Rows of ``docs`` with a struct ``result``: lang, score, n_words, spans.

    ``lang`` is the learned language with most letters; ``score`` their share of all letters,
    so 1 for a text of one language. ``spans`` are runs of words (ordinals, end exclusive) of
    one language. A null text, an empty one or one without letters is ``und`` with score 0,
    as is every text if nothing was learned. Rows are judged alone: repeated rows get equal
    results, other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        names = model.langs

        def work(texts):
            words = Words(texts)
            if not names:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts), np.diff(words.first), [[]] * len(texts)]
            labels = model.label(words, switch)
            sizes = (words.end - words.start).astype(np.int64)
            langs, scores, spans = [], [], []
            for a, b in zip(words.first[:-1], words.first[1:]):
                if a == b:
                    langs.append(UNKNOWN), scores.append(0.0), spans.append([])
                    continue
                mine = labels[a:b]
                weight = np.bincount(mine, sizes[a:b], len(names))
                best = int(weight.argmax())
                cut = np.flatnonzero(mine[1:] != mine[:-1]) + 1
                edges = [0, *cut.tolist(), b - a]
                langs.append(names[best])
                scores.append(float(weight[best] / weight.sum()))
                spans.append([(s, e, names[mine[s]]) for s, e in zip(edges[:-1], edges[1:])])
            return [langs, scores, np.diff(words.first), [
                [{"start": int(s), "end": int(e), "lang": x} for s, e, x in one] for one in spans
            ]]

        return work

    return annotate(docs, text, result, RESULT, make, keep)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold of the contract: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on_fold(docs: DataFrame) -> Model:
    """Model of the documents outside the held-out fold."""
    return fit(docs.where(~held_out()))


def drop_unidentified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, in a learned language that holds ``min_score`` of the letters."""
    result = free_name(docs, "language")
    found = identify(docs, fit_on_fold(docs), result)
    good = (F.col(result)["lang"] != UNKNOWN) & (F.col(result)["score"] >= min_score)
    return found.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs, fit_on_fold(docs), "found", keep=["doc_id"])
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.size("found.spans").cast("long").alias("n_spans"),
    )
