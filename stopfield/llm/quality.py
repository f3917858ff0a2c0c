"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature-calibrated probabilities.

Words and runs of punctuation are hashed to ``BUCKETS`` buckets. Every bucket has a sparse random index vector; its word vector is the sum of the
index vectors of its neighbours (two to each side), gathered over all documents: each task sums its own documents, the sums of tasks meet in
one aggregation by bucket. The table has a fixed size (``BUCKETS`` x ``DIM`` numbers, 1 MB) however large the corpus is, so it can be
broadcast. A document is the mean and the spread of the vectors of all its words.

The network is fitted on at most ``TRAIN_ROWS`` labelled documents (the ones of least digest of their id; a documented bound, the feature
vectors of which go to the driver: 10 MB). A fifth of them is kept from the fit and sets the temperature that divides the logit. Rows
whose crc32 of the id as text is divisible by 5 are held out and never seen in the fit. Only the text is an input of a score.

Defined cases: null and empty texts have no words and get the score that the network gives to none; a null id counts as the empty text in the
hold-out; null labels are left out; without labelled rows of both classes every score is the share of label 1 (0.5 without any); repeated
rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 13
DIM = 32
NEIGHBOURS = 2
NONZERO = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
FOLDS = 5
CUT = 0.3
PIECE = 1 << 18
"""Bytes looked at at once: bounds memory. Longer texts are taken in pieces cut at white space."""

_CLASS = np.ones(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x)])) for x in (_STEP, _BACK))
    return _POWERS[size]


def index_vectors() -> np.ndarray:
    """The random index vectors: ``NONZERO`` entries of +1 or -1 for each bucket, the same everywhere."""
    rng = np.random.default_rng(5)
    out = np.zeros((BUCKETS, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out


def word_buckets(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word of ``data`` and, for each of the texts that ``bounds`` delimits (white space between them), its first word."""
    raw = np.frombuffer(data, np.uint8)
    kinds = np.concatenate([np.zeros(1, np.uint8), _CLASS[raw], np.zeros(1, np.uint8)])
    change = kinds[1:] != kinds[:-1]
    start = np.nonzero(change & (kinds[1:] != 0))[0]
    end = np.nonzero(change & (kinds[:-1] != 0))[0]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    digest = (sums[end] - sums[start]) * down[start]
    digest ^= digest >> np.uint64(29)
    digest *= np.uint64(0xBF58476D1CE4E5B9)
    return (digest >> np.uint64(51)).astype(np.int64), np.searchsorted(start, bounds)


def _pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts joined by line breaks in runs of about ``PIECE`` bytes: the bytes, the bounds of the texts in them, the rows they belong to."""
    parts, rows, size = [], [], 0

    def emit():
        bounds = np.cumsum([0, *[len(p) + 1 for p in parts]])
        return b"\n".join(parts) + b"\n", bounds, np.array(rows)

    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        while data:
            part, data = data, b""
            if len(part) > PIECE:
                cut = max(part.rfind(b" ", 0, PIECE), part.rfind(b"\n", 0, PIECE))
                cut = cut if cut > 0 else PIECE
                part, data = part[:cut], part[cut:]
            parts.append(part)
            rows.append(row)
            size += len(part)
            if size >= PIECE:
                yield emit()
                parts, rows, size = [], [], 0
    if parts:
        yield emit()


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    spots = [np.argsort(-np.abs(index), axis=1, kind="stable")[:, i] for i in range(NONZERO)]
    signs = [index[np.arange(BUCKETS), s] for s in spots]
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        for data, bounds, _ in _pieces(batch.column(0).to_pylist()):
            bucket, first = word_buckets(data, bounds)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for away in range(1, NEIGHBOURS + 1):
                same = np.nonzero(text[away:] == text[:-away])[0]
                left, right = bucket[same], bucket[same + away]
                for word, other in ((left, right), (right, left)):
                    for spot, sign in zip(spots, signs):
                        total += np.bincount(word * DIM + spot[other], sign[other], minlength=BUCKETS * DIM)
    seen = total.reshape(BUCKETS, DIM)
    used = np.nonzero(seen.any(axis=1))[0]
    values = [pa.array(seen[used, i].astype(np.int64)) for i in range(DIM)]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *values], ["bucket", *[f"v{i}" for i in range(DIM)]])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all buckets, gathered over every document: unit context vectors beside the index vectors."""
    columns = [f"v{i}" for i in range(DIM)]
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_neighbour_sums, "bucket int, " + ", ".join(f"{c} long" for c in columns))
    rows = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # at most BUCKETS rows
    table = np.zeros((BUCKETS, DIM), np.float32)
    if rows.num_rows:
        table[rows.column("bucket").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
    return np.concatenate([table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9), index_vectors()], axis=1)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row of features per text: mean and spread of its words' vectors and the logarithm of its number of words; zeros without words."""
    n, width = len(texts), vectors.shape[1]
    sums, squares, counts = np.zeros((n, width)), np.zeros((n, width)), np.zeros(n)
    for data, bounds, rows in _pieces(texts):
        bucket, first = word_buckets(data, bounds)
        size = np.diff(first)
        some = np.nonzero(size)[0]
        if not len(some):
            continue
        found = vectors[bucket]
        np.add.at(sums, rows[some], np.add.reduceat(found, first[some], axis=0))
        np.square(found, out=found)
        np.add.at(squares, rows[some], np.add.reduceat(found, first[some], axis=0))
        np.add.at(counts, rows[some], size[some])
    mean = sums / np.maximum(counts, 1)[:, None]
    spread = np.sqrt(np.maximum(squares / np.maximum(counts, 1)[:, None] - mean**2, 0))
    return np.concatenate([mean, spread, np.log1p(counts)[:, None]], axis=1).astype(np.float32)


class Network:
    """Two layers (tanh, logistic) over standardised features, fitted by Adam; the logit is divided by a temperature."""

    def __init__(self, prior: float):
        self.prior, self.layers, self.temperature = prior, None, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        shift, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - shift) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, kept: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> Network:
        """Fit on the rows that are not ``kept``, calibrate on those that are."""
        rng, fit = np.random.default_rng(0), np.nonzero(~kept)[0]
        shift, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z, width = (x - shift) / scale, x.shape[1]
        params = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(fit)
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                hidden = np.tanh(z[rows] @ params[0] + params[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
                back = np.outer(error, params[2]) * (1 - hidden**2)
                grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), hidden.T @ error + decay * params[2], np.array([error.sum()])]
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.layers = (shift, scale, *params)
        if kept.any():
            raw, target = np.clip(self.logits(x[kept]), -60, 60), y[kept]
            tries = np.exp(np.linspace(np.log(0.2), np.log(10), 80))
            loss = [np.mean(np.logaddexp(0, raw / t) - target * raw / t) for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])
        return self


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _features(vectors, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1).to_pylist(), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, train_rows: int = TRAIN_ROWS) -> Network:
    """The network, from at most ``train_rows`` labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("l"), "l", "quality").limit(train_rows)
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l")).select("doc_id", "text", "quality")
    found = rows.mapInArrow(_features(spark.sparkContext.broadcast(vectors), kind), f"doc_id {kind}, quality int, x array<float>").toArrow()
    y = np.asarray(found.column("quality").to_pylist(), float)
    net = Network(float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y)) < 2:
        return net
    x = np.stack(found.column("x").to_numpy())
    ids = np.array([str(i) for i in found.column("doc_id").to_pylist()])
    order = np.argsort(ids, kind="stable")
    x, y = x[order].astype(float), y[order]
    return net.fit(x, y, np.arange(len(y)) % FOLDS == 0)


def scored(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, score_col: str = "quality_score") -> DataFrame:
    """``docs`` (doc_id, text and whatever else, kept) with ``score_col``, the probability of label 1; a name that ``docs`` lacks."""
    if score_col in docs.columns:
        raise ValueError(f"the table has a column {score_col}")
    vectors = word_vectors(docs)
    net = fitted(docs, labels, vectors, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, model = shared.value
        for batch in batches:
            column = batch.schema.get_field_index("text")
            score = model.scores(pooled(batch.column(column).cast(pa.string()).to_pylist(), table))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(float), pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score and predicted (1 from ``CUT`` on)."""
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
