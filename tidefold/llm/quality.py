"""Quality: an additive model of lookup tables, one per feature and pair, boosted cyclically with shallow trees."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

FEATURES = (
    "words", "word_length", "longest", "upper", "digits", "symbols", "commas", "stops", "pipes", "bangs",
    "short_words", "distinct_words", "lines", "line_length", "repeated_lines", "repeated_grams", "top_word", "odd_ends",
)
BINS, PAIR_BINS, PAIRS = 32, 8, 10
#: Labelled rows the model is fitted on, about: their features come to the driver (150 bytes a row).
SAMPLE = 20_000
GOOD = 0.7
_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
#: ASCII bytes that are neither letters, digits, white space nor common in sentences.
_SYMBOL = np.array([33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-?()!" for b in range(256)])
_ODD_END = re.compile(rb"[^0-9A-Za-z\x80-\xff.,;:'\"?)!\s](?=\s|$)")


def features(text: str | None) -> list[float]:
    """What the model sees of a whole text; all zero for one without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    upper = sum(map(str.isupper, text)) if not text.isascii() else int(counts[_UPPER].sum())
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum() + counts[128:].sum() // 2))
    common = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    return [
        math.log1p(n), float(lengths.mean()), math.log1p(int(lengths.max())), upper / letters, float(counts[_DIGIT].sum()) / size,
        float(counts[_SYMBOL].sum()) / size, float(counts[44]) / n, float(counts[46]) / n, float(counts[124]) / n, float(counts[33]) / n,
        float((lengths <= 3).mean()), len(common) / n, math.log1p(len(lines)), math.log1p(size / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(grams)) / max(1, len(grams)), max(common.values()) / n, len(_ODD_END.findall(data)) / n,
    ]


@dataclass
class Model:
    """Upper edges of the bins of each feature, its table, tables of pairs over coarser bins, and an intercept."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def coarse(self, b: np.ndarray) -> np.ndarray:
        return b * PAIR_BINS // BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: table entries are looked up and added."""
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        c = self.coarse(b)
        for (i, j), t in self.pairs.items():
            z += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """Values of a tree of this depth over ordered bins, from the sums of gradients and curvatures in each."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth and len(g) > 1:
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1)
        gain[(b < least) | (h.sum() - b < least)] = -1
        k = int(gain.argmax())
        if gain[k] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out[: k + 1] = _leaves(g[: k + 1], h[: k + 1], depth - 1, least)
            out[k + 1 :] = _leaves(g[k + 1 :], h[k + 1 :], depth - 1, least)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut along each of two axes: values of its four parts, and their gain."""
    best, value = -1.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            gs = np.array([cg[i, j], cg[i, -1] - cg[i, j], cg[-1, j] - cg[i, j], cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j]])
            hs = np.array([ch[i, j], ch[i, -1] - ch[i, j], ch[-1, j] - ch[i, j], ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j]])
            gain = float((gs**2 / (hs + 1.0)).sum())
            if gain > best and (hs >= least).sum() >= 2:
                best, v = gain, gs / (hs + 1.0)
                value = np.empty_like(g)
                value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = v
    return value, best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, rate: float = 0.1, depth: int = 2, least: float = 2.0) -> Model:
    """Boosts the tables: each round visits every feature in turn and adds a small tree fitted to what is left.

    Pairs follow: the PAIRS whose best four-part tree explains most of what the single tables leave.
    """
    p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Model(float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.edges]
    z = np.full(len(y), model.intercept)

    def left() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            r, w = left()
            step = rate * _leaves(np.bincount(b[:, j], r, BINS), np.bincount(b[:, j], w, BINS), depth, least)
            table += step
            z += step[b[:, j]]
    c = model.coarse(b)
    cell = {(i, j): c[:, i] * PAIR_BINS + c[:, j] for i, j in combinations(range(x.shape[1]), 2)}
    grid = lambda key, v: np.bincount(cell[key], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    r, w = left()
    gains = sorted(((_quarters(grid(k, r), grid(k, w), least)[1], k) for k in cell), reverse=True)
    model.pairs = {k: np.zeros((PAIR_BINS, PAIR_BINS)) for _, k in gains[:PAIRS]}
    for _ in range(pair_rounds):
        for k, table in model.pairs.items():
            r, w = left()
            step = rate * _quarters(grid(k, r), grid(k, w), least)[0]
            table += step
            z += step.ravel()[cell[k]]
    return model


def text_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every whole text; repeated rows stay, null is like empty, no row gives none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on the features of labelled documents where `learn` holds: all, or about `sample` chosen by a hash of their id.

    Rows without a label or an id are left out; a document of several labels counts with each once, and of documents
    that share an id one counts (the one with the least features). Only the chosen documents' texts are looked at.
    """
    rows = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).distinct()
    share = sample / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = cut(rows, "labels")
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows.select("doc_id").distinct()), "doc_id", "left_semi")  # about `sample` ids
    each = text_features(chosen).groupBy("doc_id").agg(F.min("x").alias("x"))
    got = sorted((str(r["doc_id"]), r["y"], tuple(r["x"])) for r in each.join(F.broadcast(rows), "doc_id").select("doc_id", "y", "x").toLocalIterator())
    return train(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got]))


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE, good: float = GOOD) -> DataFrame:
    """(doc_id, score, predicted) of every document: probability of label 1, and whether it reaches `good`.

    Whole texts are reduced to features and scored in one pass. Null and empty texts have features of
    zero and are scored like any other. Without labels of both kinds every score is the share of label 1 (or one half).
    Repeated rows get equal results; an empty table gives no rows; extra columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, label, sample))
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = model.value.score(np.array([features(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= good).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
