"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting of the logistic loss: in each round every feature in turn gets a shallow tree over its bins
(at most four leaves), shrunk and added to that feature's lookup table; then the feature pairs with the largest gain on
the residuals get two-dimensional tables from depth-two trees in the same way. A score is the logistic function of the
intercept plus one table entry a feature and pair, by vectorised bin additions.

The fit uses at most ``max_fit_rows`` labelled rows (those of the smallest id hashes; all, if there are fewer). It is the
only part that samples; every whole text is scored.

Defined results: null text scores like the empty text; labels that are null or without a document are not used; a
repeated label counts each time; with no usable label all scores are 0.5; repeated documents are rows of their own;
further columns are passed through and are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, hash_share, utf8

FEATURES = ["log_words", "word_bytes", "repeated_next", "distinct_words", "upper", "exclamations", "symbols", "bars", "digits", "line_ends", "stops", "non_ascii"]


def features(data: bytes) -> list[float]:
    """FEATURES of one text."""
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n = max(1, len(words))
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    return [
        float(np.log1p(len(words))),
        (len(data) - int(count[[9, 10, 13, 32]].sum())) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        int(count[65:91].sum()) / letters,
        int(count[33]) / n,
        int(count[[35, 36, 37, 38, 42, 64, 94, 126]].sum()) / n,
        int(count[124]) / n,
        int(count[48:58].sum()) / max(1, len(data)),
        int(count[10]) / n,
        int(count[[44, 46, 59, 58, 63]].sum()) / n,
        int(count[128:].sum()) / max(1, len(data)),
    ]


@dataclass
class Gam:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]) if self.edges else np.empty((0, len(x)), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, t in enumerate(self.tables):
            total += t[b[k]]
        for i, j, t in self.pairs:
            total += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values over ordered bins, from gradient and hessian sums a bin."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
    gain[(hl < 0.2) | (hr < 0.2)] = -1.0
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-9:
        return out
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)])


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A depth-two tree over a grid: the best first cut of rows, then of columns on each side; its values and gain."""
    best, best_gain = np.zeros_like(g), 0.0
    base = g.sum() ** 2 / (h.sum() + ridge)
    for at in range(1, g.shape[0]):
        values, gain = np.zeros_like(g), -base
        for rows in (slice(None, at), slice(at, None)):
            gs, hs = g[rows].sum(0), h[rows].sum(0)
            v = _tree(gs, hs, 1, ridge)
            values[rows] = v
            gain += float((2 * v * gs - v * v * (hs + ridge / len(hs))).sum())
        if gain > best_gain:
            best, best_gain = values, gain
    return best, best_gain


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 40, n_pairs: int = 6, n_bins: int = 48, rate: float = 0.1, ridge: float = 0.5) -> Gam:
    """Fits the model to rows of FEATURES and labels 0 or 1."""
    if not len(y):
        return Gam()
    prior = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(prior / (1 - prior))))
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = residual()
            step = rate * _tree(np.bincount(b[k], g, len(t)), np.bincount(b[k], h, len(t)), 2, ridge)
            t += step
            total += step[b[k]]
    shape = [len(t) for t in model.tables]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = residual()
        cell = b[i] * shape[j] + b[j]
        return tuple(np.bincount(cell, v, shape[i] * shape[j]).reshape(shape[i], shape[j]) for v in (g, h))

    gains = sorted(((_tree2(*grid(i, j), ridge)[1], i, j) for i in range(len(shape)) for j in range(i + 1, len(shape))), reverse=True)
    model.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for gain, i, j in gains[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            step = rate * _tree2(*grid(i, j), ridge)[0]
            t += step
            total += step[b[i], b[j]]
    return model


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit_rows: int = 20_000) -> Gam:
    """Fits on labelled rows that are not held out, at most about ``max_fit_rows`` of them."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("double").alias("__label"))
    chosen = hash_share(F.xxhash64("__id"), max_fit_rows, usable.count())
    some = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).where(F.col("__id").isNotNull() & ~held_out("__id") & chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["__id", "__x"])

    got = some.mapInArrow(measure, "__id long, __x array<double>").join(usable.where(chosen), "__id").select("__id", "__label", "__x").toArrow()
    if not got.num_rows:
        return Gam()
    x = np.array(got.column(2).to_pylist())
    y = got.column(1).to_numpy()
    order = np.lexsort([*x.T, y, got.column(0).to_numpy()])
    return fit(x[order], (y[order] > 0).astype(float))


def score(docs: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new column; a column of that name is an error."""
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score_col} already")
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    names = [x.name for x in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([features(t) for t in utf8(batch.column(batch.schema.get_field_index(text_col)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names[:-1]), pa.array(model.scores(x), pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    name = free_name(docs, "score")
    return score(docs, learn(docs, labels), score_col=name).where(F.col(name) >= threshold).drop(name)
