"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time, learns a lookup table for each feature; then
one for each of the pairs of features that explain most of what is left. A score is a sum of looked-up
bins, so scoring is a vectorised addition and every part of the model can be read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, texts, tidy
from .labelled import SAMPLE_ROWS, remainder, sample

BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 150, 80, 0.15, 4, 1.0
#: One row in so many is held out, and the threshold of predicted.
FOLDS, THRESHOLD = 5, 0.3

MARKS = b"!%&*#$|.,;:?<>{}=/\"'@_-+~^"
FEATURES = ["log_bytes", "log_words", "log_lines", "upper", "digits", "blanks", "newlines", "wide", "marks", "word_length", "longest_word", "line_length", "repeated_lines", "distinct_words", "top_word", "short_words", "ends_in_mark", "starts_in_mark", "upper_words", "stop_ends", "repeated_pairs", "short_lines"] + [f"mark_{chr(b)}" for b in MARKS]

_UPPER = np.zeros(256, np.bool_)
_UPPER[65:91] = True


def features(text: bytes) -> list[float]:
    """Numbers that describe the form of a text; none depends on its language or source."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    marks = [int(counts[b]) for b in MARKS]
    words, lines = text.split(), text.split(b"\n")
    w = max(1, len(words))
    seen = Counter(words)
    lengths = list(map(len, words)) or [0]
    filled = [x for x in lines if x.strip()]
    last = Counter(x[-1] for x in words)
    first = Counter(x[0] for x in words)
    lone = set(MARKS)
    pairs = len(set(zip(words, words[1:])))
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        int(counts[65:91].sum()) / n,
        int(counts[48:58].sum()) / n,
        int(counts[32]) / n,
        int(counts[10]) / n,
        int(counts[128:].sum()) / n,
        sum(marks) / n,
        sum(lengths) / w,
        max(lengths),
        n / len(lines),
        1 - len(set(filled)) / max(1, len(filled)),
        len(seen) / w,
        (max(seen.values()) if seen else 0) / w,
        sum(k <= 3 for k in lengths) / w,
        sum(c for b, c in last.items() if b in lone) / w,
        sum(c for b, c in first.items() if b in lone) / w,
        sum(c for x, c in seen.items() if x.isupper() and len(x) > 1) / w,
        last.get(46, 0) / w,
        1 - pairs / max(1, len(words) - 1),
        sum(len(x) < 30 for x in filled) / max(1, len(filled)),
        *[m / n for m in marks],
    ]


@dataclass
class Additive:
    """edges of each feature's bins, a table for each feature and for each pair, and the intercept."""

    intercept: float
    edges: list = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        z = np.full(len(x), self.intercept)
        for k, edges in enumerate(self.edges):
            z += self.tables[k][np.searchsorted(edges, x[:, k], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles, so that ties make fewer bins."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """Step for each bin of a tree on ordered bins: greedy splits of the largest gain."""
    n = len(gradient)
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + RIDGE)
    parts = [(0, n)]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for at, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], at, int(cuts[k]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(n)
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + RIDGE)
    return out


def _pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Step for each cell of a tree on a grid: one cut of one feature, then one of the other on either side."""
    ridge, best, out = 4 * RIDGE, 1e-9, np.zeros_like(gradient)
    worth = lambda g, h: g**2 / (h + ridge)
    base = worth(gradient.sum(), hessian.sum())
    for turned in (False, True):
        g, h = (gradient.T, hessian.T) if turned else (gradient, hessian)
        down = [np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (g, h)]  # sums of all cells up to a cell
        sides = [(x[:-1], x[-1] - x[:-1]) for x in down]  # rows before each cut, and rows from it on
        found = []
        for (cg, ch) in zip(*sides):
            gains = worth(cg[:, :-1], ch[:, :-1]) + worth(cg[:, -1:] - cg[:, :-1], ch[:, -1:] - ch[:, :-1])
            found.append((gains.max(axis=1), gains.argmax(axis=1) + 1))
        total = found[0][0] + found[1][0] - base
        at = int(total.argmax())
        if total[at] > best:
            best, out = total[at], np.zeros_like(gradient)
            shape = out.T if turned else out
            for rows, (_, cuts) in zip((slice(0, at + 1), slice(at + 1, None)), found):
                for columns in (slice(0, cuts[at]), slice(cuts[at], None)):
                    shape[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit on features and labels; without both labels the score is the share of label 1, or a half."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        return Additive(math.log((share * len(y) + 1) / ((1 - share) * len(y) + 1)))
    model = Additive(math.log(share / (1 - share)))
    model.edges = [_edges(x[:, k], BINS) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)])
    width = BINS + 1
    model.tables = np.zeros((x.shape[1], width))
    z = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for k in range(x.shape[1]):
            if not len(model.edges[k]):
                continue
            p = 1 / (1 + np.exp(-z))
            n = len(model.edges[k]) + 1
            step = RATE * _tree(np.bincount(binned[k], y - p, n), np.bincount(binned[k], p * (1 - p), n), LEAVES)
            model.tables[k, :n] += step
            z += step[binned[k]]
    _fit_pairs(model, x, y, z)
    return model


def _fit_pairs(model: Additive, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
    """Choose the pairs whose grid of bins explains most of the residual; boost their tables by trees in turn."""
    model.pair_edges = [_edges(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.pair_edges)]
    side = PAIR_BINS + 1
    p = 1 / (1 + np.exp(-z))
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            if len(model.pair_edges[a]) and len(model.pair_edges[b]):
                cell = coarse[a] * side + coarse[b]
                g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
                gains.append((float((g**2 / (h + 4 * RIDGE)).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((side, side)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-z))
            cell = coarse[a] * side + coarse[b]
            g, h = (np.bincount(cell, w, side * side).reshape(side, side) for w in (y - p, p * (1 - p)))
            step = RATE * _pair_tree(g, h)
            model.pair_tables[k] += step
            z += step.reshape(-1)[cell]


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return docs.select("text", "y").mapInArrow(tidy(run), "x array<double>, y int")


def train(docs: DataFrame, labels: DataFrame, label: str, learnt, rows: int = SAMPLE_ROWS) -> Additive:
    """Fit on a bounded sample; features are made on the workers, the driver gets at most `rows` short rows.

    Null labels and ids are left out, null texts are empty, repeated rows count once; without rows of both labels the score is one number for all. Further columns don't matter.
    """
    small_batches(docs.sparkSession)
    found = _feature_rows(sample(docs, labels, label, learnt, rows=rows)).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T[::-1]) if len(x) else []
    return fit(x[order], np.array(found.column("y").to_pylist(), float)[order]) if len(x) else fit(x, np.zeros(0))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score). Null text scores as empty text, a text of any length is one row of features; rows
    with null or repeated ids are scored too; further columns of any name don't matter."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in texts(batch.column(1))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text).mapInArrow(tidy(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents; rows of remainder 0 are never learnt from."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, "quality", remainder(F.col("doc_id"), FOLDS) != 0)
    out = score(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
