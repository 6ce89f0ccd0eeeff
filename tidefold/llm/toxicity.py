"""Toxicity: logistic regression over hashed words, word pairs and skip pairs, learned by FTRL-proximal.

Each coordinate has a rate of its own, and L1 keeps most weights at zero, so a model is a short list of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: Buckets of each kind of gram, as a power of two; kinds (words, pairs, pairs around one word) have buckets apart. There
#: are so many that even texts of a million different words hardly meet the few that have weights by chance.
BITS = 30
#: Leading bits of a bucket by which a map tells those without weights.
MAP_BITS = 22
#: Labelled documents, and bytes of their texts, that the model is fitted on, about: some two bytes of buckets for each
#: byte of text come to the driver.
SAMPLE, SAMPLE_BYTES = 20_000, 40_000_000
TOXIC = 0.7
#: Bytes of a text that are hashed at once; a longer word stays whole.
BLOCK = 1 << 20
#: ASCII letters and digits and all beyond ASCII are parts of words, all else parts them.
_WORDS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_BASE, _ONE, _TWO, _MIX = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _MIX
    return h ^ h >> np.uint64(29)


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word between blanks: its bytes times powers of a base, by their place in the word."""
    a = np.frombuffer(b" " + data + b" ", np.uint8)
    blank = a == 32
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if not len(start):
        return np.zeros(0, np.uint64)
    size = np.flatnonzero(~blank[:-1] & blank[1:]) + 1 - start
    powers = np.multiply.accumulate(np.full(int(size.max()), _BASE))
    letters = a[~blank].astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    return _mixed(np.add.reduceat((letters + np.uint64(1)) * powers[place], first))


def grams(text: str | None) -> np.ndarray:
    """Buckets of all grams of a whole text, repeats included; none for a text without words."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORDS)
    out, last, at = [], np.zeros(0, np.uint64), 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        new = _word_hashes(data[at:end])
        h = np.concatenate([last, new])  # two words of the block before, for what crosses the border
        own, k = len(last), len(h)
        pairs = _mixed(h[:-1] * _ONE + h[1:])[max(0, own - 1) :] if k > 1 else new[:0]
        around = _mixed(h[:-2] * _TWO + h[2:])[max(0, own - 2) :] if k > 2 else new[:0]
        for kind, x in enumerate((new, pairs, around)):
            out.append((x >> np.uint64(64 - BITS)).astype(np.uint32) + np.uint32(kind << BITS))
        last, at = h[-2:], end
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """The buckets whose weights aren't zero in ascending order, their weights, and an intercept."""

    intercept: float
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def seen(self) -> np.ndarray:
        """A map of the leading bits of the buckets."""
        m = np.zeros(1 << MAP_BITS, bool)
        m[self.buckets >> np.uint32(32 - MAP_BITS)] = True
        return m

    def score(self, text: str | None, seen: np.ndarray) -> float:
        """Probability of label 1: each bucket that the text reaches counts once."""
        found = grams(text)
        found = np.isin(self.buckets, found[seen[found >> np.uint32(32 - MAP_BITS)]])
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[found].sum(), -30, 30))))


def _places(known: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where the members of a row are among the known ones, in ascending order; -1 for others."""
    at = np.searchsorted(known, row)
    return np.where(np.append(known, 0)[at] == row, at, -1) if len(known) else np.full(len(row), -1)


def train(rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 4) -> Model:
    """Goes through the rows (distinct buckets each) in their order, some times over.

    z sums gradients, less what keeps the weights so far where they are, and n squared gradients; a weight is zero until
    |z| exceeds l1. A gram of few rows can't get there, as a gradient is below 1: those of l1 / epochs rows or fewer are
    left out from the start. The intercept starts at the share of label 1 and has no l1. Rows of one label give that
    intercept alone.
    """
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Model(start)
    known, times = np.unique(np.concatenate(rows), return_counts=True)
    known = known[times * epochs > l1]
    z, n = np.zeros(len(known)), np.zeros(len(known))
    places = [at[at >= 0] for at in (_places(known, row) for row in rows)]
    bias, bias_n = start, 0.0

    def weights(z: np.ndarray, root: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + root) / alpha + l2)

    for _ in range(epochs):
        for at, label in zip(places, y, strict=True):
            root = np.sqrt(n[at])
            w = weights(z[at], root)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    found = np.flatnonzero(np.abs(z) > l1)
    return Model(bias, known[found], weights(z[found], np.sqrt(n[found])))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on the texts of labelled documents where `learn` holds: all, or about `sample` and `sample_bytes` of them.

    They are chosen by hashes of their id and of id and text, and taken in the order of a hash, so reruns agree. Rows
    without an id or a label of 0 or 1 are left out; a document of both labels counts with each, repeated labels once.
    Only the chosen documents' distinct buckets come to the driver.
    """
    rows = labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y")).distinct()
    part = lambda share, *of: F.pmod(F.xxhash64(*of), F.lit(1 << 30)) < int(share * (1 << 30))
    if (share := sample / max(1, rows.count())) < 1:
        rows = rows.where(part(share, "doc_id"))
    rows = cut(rows, "labels")
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # about `sample` ids
    size = chosen.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > sample_bytes:
        chosen = chosen.where(part(sample_bytes / size, "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array([np.unique(grams(t.as_py())).tobytes() for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["at", "y", "found"])

    placed = chosen.select(F.xxhash64("text", "doc_id").alias("at"), "y", "text").mapInArrow(run, "at long, y double, found binary")
    got = sorted((r["at"], r["y"], bytes(r["found"])) for r in placed.toLocalIterator())
    return train([np.frombuffer(r[2], np.uint32) for r in got], np.array([r[1] for r in got]))


def score_toxicity(docs: DataFrame, model: Model, toxic: float = TOXIC) -> DataFrame:
    """(doc_id, score, predicted) of every document: probability of label 1, and whether it reaches `toxic`.

    Whole texts are hashed, in blocks, and looked up in one pass. Null texts are like empty ones: they have no grams and
    get the intercept's score, which is the share of label 1 where one label alone was seen, and one half without any.
    Repeated rows get equal results; null ids stay; an empty table gives no rows; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value.seen()
        for batch in slices(batches):
            s = np.array([shared.value.score(t.as_py(), seen) for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= toxic).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
