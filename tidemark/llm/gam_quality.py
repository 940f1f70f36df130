"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting adds one shallow tree of one feature at a time to that
feature's lookup table, in turns over all features; the pairs whose bin grids explain most of what is left then get
two-dimensional tables in the same way. A score is the sigmoid of the sum of table entries, looked up for whole
batches at once. The labels' sample is bounded (SAMPLE_ROWS); scoring covers every document.

Null and empty texts have all-zero features and get a score like any other text. Without labelled rows, or with one
class only, the score is the smoothed share of label 1. Rows are independent; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, bounded_batches, text_of
from ._labels import SAMPLE_ROWS, held_out, labelled_sample

FEATURES = ("log_bytes", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "blank", "newline", "high", "word_length", "distinct", "top_word", "repeated_runs", "repeated_lines", "sentence_length", "one_letter", "long_words")
FOLDS, HELD = 4, 2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*b"#$%&*+/<=>@[\\]^_`{}~"]] = True


def features(text: str) -> list[float]:
    """The features of one text, each from the whole of it."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    letters = max(1, upper + lower)
    words = data.lower().split()
    k = max(1, len(words))
    seen = Counter(words)
    runs = list(zip(words, words[1:], words[2:], words[3:], strict=False))
    lines = [x for x in data.split(b"\n") if x]
    stops = int(count[46] + count[63] + count[33])
    sizes = [len(w) for w in words]
    return [
        float(np.log2(n + 1)),
        upper / letters,
        digit / n,
        float(count[_SYMBOLS].sum()) / n,
        float(count[124]) / n,
        float(count[33]) / n,
        float(count[46]) / k,
        float(count[32] + count[9]) / n,
        float(count[10]) / n,
        float(count[128:].sum()) / n,
        sum(sizes) / k,
        len(seen) / k,
        max(seen.values(), default=0) / k,
        1 - len(set(runs)) / len(runs) if runs else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        k / (stops + 1),
        sizes.count(1) / k,
        sum(s > 20 for s in sizes) / k,
    ]


def feature_matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def _best_split(g: np.ndarray, h: np.ndarray, low: int, high: int, ridge: float) -> tuple[float, int]:
    """The cut of bins [low, high) with the largest gain."""
    if high - low < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(gain.argmax())
    return float(gain[at]), low + at + 1


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """A shallow tree over ordered bins, as its value for each bin."""
    parts = [(0, len(g))]
    for _ in range(depth):
        cut = []
        for low, high in parts:
            gain, at = _best_split(g, h, low, high, ridge)
            cut += [(low, at), (at, high)] if gain > 1e-9 else [(low, high)]
        parts = cut
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """A shallow tree over a grid: one cut along one axis, then one along the other on either side."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for at in range(1, max(2, len(gg))):
            value, total = np.zeros_like(gg), 0.0
            for rows in (slice(0, at), slice(at, None)):
                row_g, row_h = gg[rows].sum(0), hh[rows].sum(0)
                value[rows] = side = _tree(row_g, row_h, ridge, 1)
                total += float((side * row_g).sum())
            if total > best:
                best, out = total, value.T if flip else value
    return out


class AdditiveModel:
    """Lookup tables of single features and of feature pairs."""

    def __init__(self, bins: int = 48, coarse: int = 10, pairs: int = 6, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 5.0):
        self.bins, self.coarse, self.pairs, self.rounds, self.pair_rounds, self.rate, self.ridge = bins, coarse, pairs, rounds, pair_rounds, rate, ridge

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        count, width = x.shape
        self.base = float(np.log((y.sum() + 1) / (count - y.sum() + 1)))
        self.cuts = [self._edges(x[:, j], self.bins) for j in range(width)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.rough = [self._edges(x[:, j], self.coarse) for j in range(width)]
        self.grids: dict[tuple[int, int], np.ndarray] = {}
        if count == 0 or y.min() == y.max():
            return self
        at = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)]
        margin = np.full(count, self.base)
        for _ in range(self.rounds):
            for j in range(width):
                p = 1 / (1 + np.exp(-margin))
                g = np.bincount(at[j], y - p, len(self.tables[j]))
                h = np.bincount(at[j], p * (1 - p), len(self.tables[j]))
                step = self.rate * _tree(g, h, self.ridge)
                self.tables[j] += step
                margin += step[at[j]]
        rough = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.rough)]
        p = 1 / (1 + np.exp(-margin))
        gains, cells, shapes = [], {}, {}
        for a in range(width):
            for b in range(a + 1, width):
                shape = (len(self.rough[a]) + 1, len(self.rough[b]) + 1)
                cell = rough[a] * shape[1] + rough[b]
                g = np.bincount(cell, y - p, shape[0] * shape[1])
                h = np.bincount(cell, p * (1 - p), shape[0] * shape[1])
                gains.append((float((g**2 / (h + self.ridge)).sum()), a, b))
                cells[a, b], shapes[a, b] = cell, shape
        chosen = [(a, b) for _, a, b in sorted(gains, reverse=True)[: self.pairs]]
        self.grids = {k: np.zeros(shapes[k]) for k in chosen}
        for _ in range(self.pair_rounds):
            for k in chosen:
                p = 1 / (1 + np.exp(-margin))
                size = self.grids[k].size
                g = np.bincount(cells[k], y - p, size).reshape(shapes[k])
                h = np.bincount(cells[k], p * (1 - p), size).reshape(shapes[k])
                step = self.rate * _grid_tree(g, h, self.ridge)
                self.grids[k] += step
                margin += step.ravel()[cells[k]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        margin = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            margin += values[np.searchsorted(cuts, x[:, j], "left")]
        for (a, b), grid in self.grids.items():
            margin += grid[np.searchsorted(self.rough[a], x[:, a], "left"), np.searchsorted(self.rough[b], x[:, b], "left")]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def with_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the text's features as one array column."""
    bounded_batches(docs.sparkSession)
    kept = docs.select(*keep, text_of().alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batch):
        rows = pa.array(feature_matrix(batch.column(batch.num_columns - 1).to_pylist()).tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], names=[*keep, "features"])

    return arrow_map(kept, run, f"{schema}, features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fit on the bounded labelled sample; only its features reach the driver."""
    sample = with_features(labelled_sample(docs, labels, "quality", FOLDS, HELD, rows), "doc_id", "label").toPandas().sort_values("doc_id")
    x = np.array(sample["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, sample["label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every document."""
    bounded_batches(docs.sparkSession)

    def run(batch):
        score = model.score(feature_matrix(batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), run, "doc_id long, score double")


#: A document is accepted from this score on.
THRESHOLD = 0.7


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text the classifier accepts."""
    bounded_batches(docs.sparkSession)
    model, schema, names = fit_quality(docs, labels), docs.schema, docs.columns
    text = names.index("text")

    def run(batch):
        texts = [t or "" for t in batch.column(text).to_pylist()]
        return batch.filter(pa.array(model.score(feature_matrix(texts)) >= THRESHOLD))

    return arrow_map(docs, run, schema)
