"""Operator 10, quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned by quantiles. Boosting goes round the features in a cycle: each step
fits a shallow tree (up to three leaves) on one feature's bins to the residuals, and adds it, shrunk,
to that feature's lookup table; then the strongest pairs of features get two-way tables the same way.
A score is the sum of one table entry for each feature and pair, so scoring a batch is a few vectorised
additions. Texts are read once, in Arrow batches, without a shuffle.

The model is fitted on at most ``sample_rows`` labelled rows (documented bound, default 20,000), those
with the smallest hash of doc_id among the rows that may be learned from: crc32(doc_id as text) mod 5
is not 0, and the label is not null. doc_id only chooses rows; labels, lang and source are never inputs.

Null and empty texts get the features of an empty text and so a score. Repeated documents get a result
each; a document with several labels counts once for each; a null doc_id is scored and never learned
from. Without labels of both kinds every score is the labels' mean (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm.common import id_text

FEATURES = ["log_chars", "log_words", "mean_word", "symbol_rate", "marked_words", "bang_rate", "capital_rate", "digit_rate", "distinct_rate", "repeat_rate", "line_end_rate", "stop_rate", "line_words", "dup_line_rate"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL_RUN = re.compile(r"[#*$%&|<>]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
REPEATED = re.compile(r"(?<![^\s])(\S+)\s+(?=\1(?!\S))")
DIGITS = re.compile(r"[0-9]+")
SENTENCE_END = (".", "!", "?", '"', "”", "»", ":")


def features(text: str) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    words = WORDS.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    symbols = [len(x) for x in SYMBOL_RUN.findall(text)]
    capitals = [len(x) for x in CAPITALS.findall(text)]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    rows = max(1, len(lines))
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / n, sum(symbols) / n, len(symbols) / n, text.count("!!") / n, sum(capitals) / chars,
        sum(map(len, DIGITS.findall(text))) / chars, len(set(words)) / n, again / n, sum(x.rstrip().endswith(SENTENCE_END) for x in lines) / rows, sum(len(x) <= 3 for x in words) / n, n / rows, 1 - len(set(lines)) / rows if lines else 0.0,
    ]


@dataclass
class Model:
    """cuts: bin edges of each feature; tables: a score for each bin; pairs: ((i, j), scores for each two coarse bins)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cut, x[:, i], "right")]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total.clip(-30, 30)))


def _steps(gradient: np.ndarray, hessian: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The best piecewise constant Newton step over ordered bins with at most ``leaves`` pieces, found greedily."""
    g, h = np.concatenate([[0.0], gradient.cumsum()]), np.concatenate([[0.0], hessian.cumsum()])
    edges = [0, len(gradient)]
    for _ in range(leaves - 1):
        best, place = 1e-9, None
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            gl, hl, gr, hr = g[k] - g[a], h[k] - h[a], g[b] - g[k], h[b] - h[k]
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
            if gain.max() > best:
                best, place = float(gain.max()), int(k[gain.argmax()])
        if place is None:
            break
        edges = sorted([*edges, place])
    out = np.empty(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 6, rounds: int = 60, rate: float = 0.15, n_pairs: int = 6, ridge: float = 2.0) -> Model:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, coarse_bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(mean / (1 - mean))), cuts, tables, coarse, [])
    if len(np.unique(y)) < 2:
        return model
    place = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)]
    total = np.full(len(y), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(tables):
            g, h = residual()
            step = rate * _steps(np.bincount(place[i], g, len(table)), np.bincount(place[i], h, len(table)), 3, ridge)
            table += step
            total += step[place[i]]
    coarse_place = [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(coarse)]
    g, h = residual()
    strength = []
    for i in range(len(tables)):
        for j in range(i):
            width = len(coarse[j]) + 1
            cell = coarse_place[i] * width + coarse_place[j]
            size = (len(coarse[i]) + 1) * width
            strength.append((float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + ridge)).sum()), i, j))
    for _, i, j in sorted(strength, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))))
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h = residual()
            cell = coarse_place[i] * table.shape[1] + coarse_place[j]
            step = rate * np.bincount(cell, g, table.size) / (np.bincount(cell, h, table.size) + ridge)
            table += step.reshape(table.shape)
            total += step[cell]
    return model


def _measured(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.select(keep), np.array([features(t.as_py()) for t in batch.column(at)], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 20_000) -> Model:
    """Fit on the bounded sample; its features (at most sample_rows x 14 numbers) are all that reaches the driver."""
    may = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    sample = may.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    rows = id_text(docs).join(F.broadcast(sample), "doc_id").select("text", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, x in _measured(batches, ["y"]):
            yield pa.RecordBatch.from_arrays([left.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    found = rows.mapInArrow(measure, "y int, x array<double>").toArrow()
    y = found["y"].to_numpy().astype(float)
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, x in _measured(batches, ["doc_id"]):
            ids = left.column(0).to_pylist()
            held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in ids]
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([left.column(0), pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return id_text(docs).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, cut: float = 0.3) -> DataFrame:
    return scored(docs, train(docs, labels, sample_rows=sample_rows), cut)
