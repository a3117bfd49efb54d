"""Quality classifier by co-training of a text view and a metadata view.

Two logistic classifiers see disjoint views of a document: its text (hashed presence of
words and surface statistics) and its metadata (source, language, declared length).
In every round each view scores all unlabelled documents and hands its most confident ones,
as pseudo-labels, to the *other* view, which learns from them in the next round. A held-out
part of the labelled rows then calibrates each view (Platt) and fits the combination of the
calibrated views, which scores every document.

Only labelled rows are sampled (``fit_rows`` distinct ones, as numbers, never texts). Copies
are one row with a weight before that. Unlabelled rows stay in Spark: a round takes two passes
over their features. One sums weights by metadata cell and confidence, which tells the share
to hand over and gives the metadata view its pseudo-labels exactly. The other sums gradients
and curvatures per feature over what the metadata view hands to the text view; the driver
minimizes the loss of the labelled rows plus the quadratic majorant of the pseudo-labelled
ones that these sums make. The driver gets a row per feature and per cell, whatever the input.
Scoring covers all rows inside the rows, without an exchange.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import annotate, free_name, materialize
from gleaner.sources.tables import read_table

#: Expected number of distinct labelled rows that the driver fits on.
FIT_ROWS = 6000
BITS = 18
#: A word counts if it occurs in so many documents at least.
MIN_DOCS = 5
ROUNDS = 4
#: Pseudo-labels need this calibrated confidence; per view and class their share of the pool grows by this in every round.
CONFIDENCE, SHARE = 0.95, 0.1
#: Weight of a pseudo-labelled document; bins per unit of a calibrated logit, and the logit beyond which all are alike.
PSEUDO, BINS, FAR = 0.5, 10, 20
#: Documents below this score are rejected.
THRESHOLD = 0.5

N_SURFACE = 10
FEATURES = T.StructType([
    T.StructField("words", T.ArrayType(T.IntegerType())),
    T.StructField("surface", T.ArrayType(T.FloatType())),
])
SCORE = T.StructType([T.StructField("text_logit", T.DoubleType())])

# Byte classes of the surface statistics.
_SYMBOL = bytes(1 if chr(b) in "#*$%&|<>@^~=_{}[]\\" else 0 for b in range(256))
_UPPER = bytes(1 if 65 <= b <= 90 else 0 for b in range(256))
_DIGIT = bytes(1 if 48 <= b <= 57 else 0 for b in range(256))
_LETTER = bytes(1 if b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 else 0 for b in range(256))
_BARE = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_codes(text: bytes) -> np.ndarray:
    """Sorted distinct hashed words (letters only, A-Z in lower case)."""
    found = set(text.translate(_BARE).split())
    return np.unique(np.fromiter((zlib.crc32(w) >> (32 - BITS) for w in found), np.int64, len(found)))


def surface(text: bytes) -> list[float]:
    """Shares and log counts that describe the form of a text; zeros for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * N_SURFACE
    lines = text.split(b"\n")
    letters = text.translate(_LETTER).count(1)
    return [
        text.translate(_SYMBOL).count(1) / n,
        text.translate(_UPPER).count(1) / max(1, letters),
        text.translate(_DIGIT).count(1) / n,
        text.count(b"!") / n,
        text.count(b"|") / len(words),
        1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / len(words),
        n / len(words) / 10,
        np.log1p(len(words)) / 10,
        letters / n,
    ]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Rows of distinct feature numbers with values, plus the dense part in front."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.size, self.n = size, len(rows)
        self.column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.n)

    def tdot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, g[self.row], self.size)


@dataclass
class Linear:
    """Logistic model over sparse and dense features."""

    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def logit(self, sparse: Sparse, dense: np.ndarray) -> np.ndarray:
        return sparse.dot(self.weights) + ((dense - self.mean) / self.scale) @ self.dense + self.bias


def train(
    sparse: Sparse, dense: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, l2: float = 1e-3,
    more: tuple[float, float] = (0.0, 0.0), pull: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> Linear:
    """Class-balanced logistic regression by full-batch Adam.

    ``more`` are the weights per class of rows that are not here; ``pull`` stands for them: a
    point, and gradient and curvature of their (balanced) loss there.
    """
    balance = weight.astype(float)
    for c in (0, 1):
        total = balance[y == c].sum() + more[c]
        balance[y == c] *= 0.5 / max(total, 1e-9)
    used = weight > 0
    mean = dense[used].mean(0) if used.any() else np.zeros(dense.shape[1])
    scale = (dense[used].std(0) if used.any() else np.ones(dense.shape[1])) + 1e-6
    x = (dense - mean) / scale
    theta = np.zeros(sparse.size + x.shape[1] + 1) if pull is None else pull[0].copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        a, b, c = theta[: sparse.size], theta[sparse.size : -1], theta[-1]
        error = (sigmoid(sparse.dot(a) + x @ b + c) - y) * balance
        grad = np.concatenate([sparse.tdot(error) + l2 * a, x.T @ error + l2 * b, [error.sum()]])
        if pull is not None:
            grad += pull[1] + pull[2] * (theta - pull[0])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(theta[: sparse.size], theta[sparse.size : -1], mean, scale, float(theta[-1]))


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate a logit on held-out rows; a slope is never negative."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    ab, target = np.array([1.0, 0.0]), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = sigmoid(ab[0] * logit + ab[1])
        x = np.stack([logit, np.ones_like(logit)], 1)
        grad = x.T @ (p - target) + np.array([1e-3 * ab[0], 0])
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, grad)
        ab -= np.clip(step, -1, 1)
    return max(0.0, float(ab[0])), float(ab[1])


@dataclass
class Model:
    """Both views, their calibration, and the weights of the combination."""

    columns: np.ndarray  # feature number of a word code, or -1
    text: Linear
    meta: Linear
    meta_place: dict[str, int]
    text_cal: tuple[float, float]
    meta_cal: tuple[float, float]
    combine: tuple[float, float, float]

    def text_logit(self, texts: list[bytes]) -> np.ndarray:
        rows, dense = [], np.zeros((len(texts), N_SURFACE))
        for i, text in enumerate(texts):
            codes = self.columns[word_codes(text)]
            rows.append(codes[codes >= 0])
            dense[i] = surface(text)
        raw = self.text.logit(Sparse(rows, len(self.text.weights)), dense)
        return self.text_cal[0] * raw + self.text_cal[1]


def meta_tokens(source: str, lang: str, length: str) -> Column:
    """Metadata as tokens; a null is a token of its own. The length is a power of two."""
    def token(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), F.coalesce(value.cast("string"), F.lit("?")))

    size = F.greatest(F.col(f"`{length}`").cast("double"), F.lit(0.0))
    return F.array(
        token("s:", F.col(f"`{source}`")), token("l:", F.col(f"`{lang}`")), token("n:", F.floor(F.log2(size + 1))),
        F.concat(token("s:", F.col(f"`{source}`")), token("+l:", F.col(f"`{lang}`"))),
    )


def _bin(logit: np.ndarray) -> np.ndarray:
    """Bins of calibrated logits by confidence, away from zero."""
    return np.trunc(np.clip(logit, -FAR, FAR) * BINS).astype(np.int64)


_SURE = int(np.ceil(np.log(CONFIDENCE / (1 - CONFIDENCE)) * BINS))


def _shares(weights: dict[int, float], most: float) -> dict[int, float]:
    """The part of each bin that is handed over: the surest first, ``most`` in all per class."""
    part = {}
    for sign in (1, -1):
        left = most
        for b in sorted((b for b in weights if b * sign >= _SURE), key=lambda b: -b * sign):
            part[b] = min(1.0, left / weights[b]) if left > 0 else 0.0
            left -= weights[b]
    return {b: x for b, x in part.items() if x > 0}


def _forward(model: Linear, columns: np.ndarray, words: list[np.ndarray], dense: np.ndarray) -> tuple[Sparse, np.ndarray, np.ndarray]:
    """Sparse part, scaled dense part and logits of rows."""
    codes = [c[c >= 0] for c in (columns[w] for w in words)]
    sparse = Sparse(codes, len(model.weights))
    x = (dense - model.mean) / model.scale
    return sparse, x, sparse.dot(model.weights) + x @ model.dense + model.bias


def _slopes(model: Linear, columns: np.ndarray, words: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient of the weighted loss and a diagonal that bounds its curvature, one row each: words, dense part, bias."""
    sparse, x, logit = _forward(model, columns, words, dense)
    error = weight * (sigmoid(logit) - y)
    size = np.abs(x)
    # Words with the bias, and the dense part, are bounded apart, so that a far surface value doesn't hold back the words.
    bound, dense_bound = weight / 2 * (np.bincount(sparse.row, minlength=sparse.n) + 1), weight / 2 * size.sum(1)
    return np.stack([
        np.concatenate([sparse.tdot(error), x.T @ error, [error.sum()]]),
        np.concatenate([sparse.tdot(bound), size.T @ dense_bound, [bound.sum()]]),
    ])


class Held:
    """Unlabelled rows in memory."""

    def __init__(self, words: list[np.ndarray], dense: np.ndarray, metas: list[tuple[str, ...]]):
        self.words, self.dense, self.metas = words, dense, metas

    def cells(self) -> dict[tuple[str, ...], float]:
        out = defaultdict(float)
        for m in self.metas:
            out[m] += 1
        return out

    def by_text(self, model: Linear, columns: np.ndarray, cal: tuple[float, float], most: float) -> dict[tuple, float]:
        b = _bin(cal[0] * _forward(model, columns, self.words, self.dense)[2] + cal[1]).tolist()
        weights = defaultdict(float)
        for x in b:
            weights[x] += 1
        part, out = _shares(weights, most), defaultdict(float)
        for m, x in zip(self.metas, b):
            if x in part:
                out[m, int(x > 0)] += part[x]
        return out

    def slopes(self, model: Linear, columns: np.ndarray, given: dict[tuple[str, ...], tuple[int, float]]) -> np.ndarray:
        y, weight = np.array([given.get(m, (0, 0.0)) for m in self.metas]).reshape(-1, 2).T
        return _slopes(model, columns, self.words, self.dense, y, weight)


class Dealt:
    """Unlabelled rows in Spark: meta_in, copies_in, words, surface."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def cells(self) -> dict[tuple[str, ...], float]:
        return {tuple(m): float(n) for m, n in self.rows.groupBy("meta_in").agg(F.sum("copies_in")).collect()}

    def _blocks(self, make, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts():
                for batch in batches:
                    for at in range(0, batch.num_rows, 1024):
                        part = batch.slice(at, 1024)
                        flat, ends = part.column(2).flatten().to_numpy(), np.cumsum(part.column(2).value_lengths().to_numpy())[:-1]
                        dense = part.column(3).flatten().to_numpy().reshape(-1, N_SURFACE).astype(float)
                        yield part, np.split(flat.astype(np.int64), ends), dense

            yield from make(parts())

        return self.rows.select("meta_in", "copies_in", "words", "surface").mapInArrow(run, schema)

    def by_text(self, model: Linear, columns: np.ndarray, cal: tuple[float, float], most: float) -> dict[tuple, float]:
        shared = self.rows.sparkSession.sparkContext.broadcast((model, columns))

        def make(parts):
            model, columns = shared.value
            for part, words, dense in parts:
                b = _bin(cal[0] * _forward(model, columns, words, dense)[2] + cal[1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(b)], names=["meta_in", "copies_in", "bin"])

        rows = self._blocks(make, "meta_in array<string>, copies_in long, bin long").where(F.abs("bin") >= _SURE)
        sums = materialize(rows.groupBy("meta_in", "bin").agg(F.sum("copies_in").alias("w")), "confidence")
        part = _shares({b: float(w) for b, w in sums.groupBy("bin").agg(F.sum("w")).collect()}, most)
        if not part:
            return {}
        table = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])
        taken = sums.groupBy("meta_in", (F.col("bin") > 0).cast("int").alias("y")).agg(
            F.sum(F.col("w") * F.coalesce(F.try_element_at(table, F.col("bin")), F.lit(0.0))).alias("w"))
        return {(tuple(m), y): w for m, y, w in taken.where("w > 0").collect()}

    def slopes(self, model: Linear, columns: np.ndarray, given: dict[tuple[str, ...], tuple[int, float]]) -> np.ndarray:
        shared = self.rows.sparkSession.sparkContext.broadcast((model, columns, given))
        size = len(model.weights) + N_SURFACE + 1

        def make(parts):
            model, columns, given = shared.value
            total = np.zeros((2, size))
            for part, words, dense in parts:
                y, weight = np.array([given.get(tuple(m), (0, 0.0)) for m in part.column(0).to_pylist()]).reshape(-1, 2).T
                on = np.flatnonzero(weight)
                if len(on):
                    copies = part.column(1).to_numpy()[on]
                    total += _slopes(model, columns, [words[i] for i in on], dense[on], y[on], weight[on] * copies)
            at = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["at", "g", "h"])

        sums = self._blocks(make, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        got, out = sums.toPandas(), np.zeros((2, size))
        out[:, got["at"].to_numpy(int)] = got[["g", "h"]].to_numpy(float).T
        return out


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
    length: str = "n_chars", fit_rows: int = FIT_ROWS, rounds: int = ROUNDS,
) -> Model:
    """Co-train on a sample of documents joined to ``labels`` (doc_id, good 0/1) and all unlabelled documents.

    Labels with a null id or value are ignored; of several labels of one id the lowest holds.
    Copies of a text with equal metadata and label are one row that weighs as much as they do;
    calibration counts it once.
    Without labels of both classes the model scores everything 0.5 and so rejects nothing.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("good").isNotNull())
    good = good.groupBy(F.col("doc_id").alias("id_in")).agg(F.min("good").alias("good_in"))
    base = docs.select(
        F.col(f"`{doc_id}`").alias("id_in"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text_in"),
        meta_tokens(source, lang, length).alias("meta_in"),
    ).withColumn("digest_in", F.unhex(F.md5("text_in")))

    def make():
        def work(texts):
            return [[word_codes(t or b"").tolist() for t in texts], [[float(x) for x in surface(t or b"")] for t in texts]]
        return work

    # The features move once, to meet the labels, by the same join at every size. Copies are merged where they
    # meet in a batch; what is asked of unlabelled rows are sums, and of the labelled ones the sample is merged whole.
    rows = annotate(base, "text_in", "f", FEATURES, make, keep=["id_in", "digest_in", "meta_in"])
    rows = rows.join(good.hint("merge"), "id_in", "left")
    rows = rows.select("digest_in", "meta_in", "good_in", F.lit(1).cast("long").alias("copies_in"), "f.words", "f.surface")
    rows = materialize(rows.mapInArrow(_merge_copies, rows.schema), "cotraining")
    seen = rows.select("copies_in", F.explode("words").alias("code")).groupBy("code").agg(F.sum("copies_in").alias("n"))
    codes = np.array(sorted(c for c, _ in seen.where(F.col("n") >= MIN_DOCS).collect()), np.int64)  # at most 2 ** BITS
    known, same = rows.where("good_in is not null"), ["digest_in", "meta_in", "good_in"]
    rate = min(1_000_000, 1_000_000 * fit_rows // max(known.select(*same).distinct().count(), 1))
    got = known.where(F.pmod(F.xxhash64(F.lit("fit"), "digest_in"), F.lit(1_000_000)) < rate)
    got = got.groupBy(*same).agg(F.sum("copies_in").alias("copies_in"), F.first("words").alias("words"), F.first("surface").alias("surface"))
    got = got.withColumn("hash_in", F.xxhash64(F.lit("fold"), "digest_in")).drop("digest_in").toPandas().sort_values("hash_in", kind="stable")
    return _exchange(
        [np.asarray(w, np.int64) for w in got.words], np.array([list(x) for x in got.surface]).reshape(-1, N_SURFACE),
        [tuple(m) for m in got.meta_in], got.good_in.to_numpy(float), got.copies_in.to_numpy(float), got.hash_in.to_numpy() % 4 == 0,
        Dealt(rows.where("good_in is null")), codes, rounds,
    )


def _merge_copies(batches):
    """One row for the copies of a batch, with their number."""
    for batch in batches:
        place: dict[tuple, int] = {}
        keys = zip(*(batch.column(c).to_pylist() for c in ("digest_in", "good_in")), map(tuple, batch.column("meta_in").to_pylist()))
        where = np.array([place.setdefault(k, len(place)) for k in keys], np.int64)
        first = np.unique(where, return_index=True)[1]
        at = batch.schema.get_field_index("copies_in")
        copies = np.bincount(where, batch.column(at).to_numpy(), len(place)).astype(np.int64)
        yield batch.take(pa.array(first)).set_column(at, batch.schema.field(at), pa.array(copies))


def _cotrain(
    words: list[np.ndarray], dense: np.ndarray, metas: list[list[str]], label: np.ndarray, in_held: np.ndarray, rounds: int
) -> Model:
    """Co-training of rows in memory; those without a label are the pool."""
    codes, seen = np.unique(np.concatenate([*words, np.zeros(0, np.int64)]), return_counts=True)
    known, pool = np.flatnonzero(~np.isnan(label)), np.flatnonzero(np.isnan(label))
    pick = lambda at: ([words[i] for i in at], dense[at], [tuple(metas[i]) for i in at])
    return _exchange(*pick(known), label[known], np.ones(len(known)), in_held[known], Held(*pick(pool)), codes[seen >= MIN_DOCS], rounds)


def _exchange(
    words: list[np.ndarray], dense: np.ndarray, metas: list[tuple[str, ...]], label: np.ndarray, copies: np.ndarray, in_held: np.ndarray,
    pool: Held | Dealt, codes: np.ndarray, rounds: int,
) -> Model:
    """Copies of a text share ``in_held``, so none is both learned and held out."""
    columns = np.full(1 << BITS, -1, np.int64)
    columns[codes] = np.arange(len(codes))
    cells = pool.cells()
    n_pool = sum(cells.values())
    names = sorted(cells)
    place = {t: i for i, t in enumerate(sorted({t for m in [*metas, *names] for t in m}))}
    coded = lambda ms: [np.array([place[t] for t in m], np.int64) for m in ms]
    text_x = Sparse([c[c >= 0] for c in (columns[w] for w in words)], len(codes))
    meta_x, cell_x = Sparse(coded(metas), len(place)), Sparse(coded(names), len(place))
    none = lambda n: np.zeros((n, 0))
    held, y_held = np.flatnonzero(in_held), label[in_held]
    weight = np.where(in_held, 0.0, copies)
    totals = np.array([weight[label == c].sum() for c in (0, 1)])
    text, meta = train(text_x, dense, label, weight), train(meta_x, none(len(words)), label, weight)
    for turn in range(rounds + 1):
        raw = {"text": text.logit(text_x, dense), "meta": meta.logit(meta_x, none(len(words)))}
        cal = {v: platt(x[held], y_held) for v, x in raw.items()}
        if turn == rounds or not n_pool or (~in_held).sum() < 2:
            break
        most = SHARE * (turn + 1) * n_pool
        handed = sorted(pool.by_text(text, columns, cal["text"], most).items())
        # Cells that the metadata view is sure of, to the text view.
        b = _bin(cal["meta"][0] * meta.logit(cell_x, none(len(names))) + cal["meta"][1]).tolist()
        weights = defaultdict(float)
        for m, x in zip(names, b):
            weights[x] += cells[m]
        part = _shares(weights, most)
        given = {m: (int(x > 0), PSEUDO * part[x]) for m, x in zip(names, b) if x in part}
        if given:
            more = np.array([sum(w * cells[m] for m, (y, w) in given.items() if y == c) for c in (0, 1)])
            factor = 0.5 / np.maximum(totals + more, 1e-9)
            g, h = pool.slopes(text, columns, {m: (y, w * factor[y]) for m, (y, w) in given.items()})
            text = train(text_x, dense, label, weight, more=tuple(more), pull=(np.append(np.append(text.weights, text.dense), text.bias), g, h))
        if handed:
            x = Sparse(coded([*metas, *(m for (m, _), _ in handed)]), len(place))
            y = np.append(label, [c for (_, c), _ in handed])
            meta = train(x, none(x.n), y, np.append(weight, [PSEUDO * w for _, w in handed]))
    both = np.stack([cal[v][0] * raw[v] + cal[v][1] for v in ("text", "meta")], 1)[held]
    return Model(columns, text, meta, place, cal["text"], cal["meta"], _stack(both, y_held))


def _stack(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Non-negative logistic weights of two calibrated logits, pulled towards their mean."""
    if len(y) == 0 or y.min() == y.max():
        return 0.0, 0.0, 0.0
    w = np.array([0.5, 0.5, 0.0])
    for _ in range(300):
        error = sigmoid(x @ w[:2] + w[2]) - y
        grad = np.array([*(x.T @ error / len(y)), error.mean()]) + 1e-3 * (w - np.array([0.5, 0.5, 0]))
        w = w - 0.1 * grad
        w[:2] = np.maximum(w[:2], 0)
    return tuple(float(v) for v in w)


def score(
    docs: DataFrame, model: Model, result: str, text: str = "text", source: str = "source", lang: str = "lang",
    length: str = "n_chars", keep: list[str] | None = None, threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows of ``docs`` with a struct ``result``: text_score, meta_score, score (0 to 1), kept.

    A null or empty text is judged by its (zero) features and metadata like any other; unseen
    sources, languages and words carry no weight. Equal rows get equal scores.
    """
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    meta, view = free_name(docs, "meta_in"), free_name(docs, "view_in")

    def make():
        model = shared.value

        def work(texts):
            return [model.text_logit([t or b"" for t in texts])]

        return work

    seen = docs.withColumn(meta, meta_tokens(source, lang, length))
    seen = annotate(seen, text, view, SCORE, make, [*kept, meta])
    weights = {t: float(model.meta.weights[i]) for t, i in model.meta_place.items()}
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    raw = F.aggregate(
        F.col(meta), F.lit(model.meta.bias), lambda acc, t: acc + F.coalesce(F.try_element_at(table, t), F.lit(0.0))
    )
    meta_logit = F.lit(model.meta_cal[0]) * raw + F.lit(model.meta_cal[1])
    text_logit = F.col(f"{view}.text_logit")
    a, b, c = model.combine
    squash = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    final = squash(F.lit(a) * text_logit + F.lit(b) * meta_logit + F.lit(c))
    return seen.select(
        *[F.col(f"`{x}`") for x in kept],
        F.struct(
            squash(text_logit).alias("text_score"), squash(meta_logit).alias("meta_score"), final.alias("score"),
            (final >= threshold).alias("kept"),
        ).alias(result),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    clean = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", clean.cast("int").alias("good"))
    found = score(docs, fit(docs, labels), "found", keep=["doc_id"])
    return found.select("doc_id", "found.text_score", "found.meta_score", "found.score", "found.kept")
