"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

UNKNOWN = "und"
#: Subwords are runs of GRAMS bytes of a lowered word with a space at each end, hashed to BUCKETS.
GRAMS, BUCKETS = (2, 3, 4), 1 << 12
DIMENSION = 16
#: Documents of each language that the model is fitted on, about, and of all languages together: beyond MOST / SAMPLE
#: languages each gives fewer, LEAST at least. That bounds what comes to the driver; no language is left out.
SAMPLE, MOST, LEAST = 400, 25_600, 2
#: Words of the excerpt that is learned from beside each sampled whole text, so that short texts are known too.
EXCERPT = 8
#: Share of sampled documents of known languages that calibration may reject.
REJECTED = 0.001
#: How much further than the held rows' tail a text must lie to be strange, and how far at least; weight of unseen subwords.
MARGIN, LEAST_STRANGE, UNSEEN = 1.2, -5.0, 0.05
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of letters and of characters beyond ASCII stay; all else parts words.
_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; \\w also takes numbers such as ² and Ⅷ."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def subwords(text: str | None) -> np.ndarray:
    """Buckets of all subwords of a whole text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_BYTES).split()
    a = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    space = a == 32
    out = []
    for n in GRAMS:
        if len(a) < n:
            continue
        m = len(a) - n + 1
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ a[k : k + m]) * np.uint32(0x01000193)
        inside = np.zeros(m, bool)
        for k in range(1, n - 1):
            inside |= space[k : k + m]
        if n == 2:
            inside = space[:m] & space[1:]
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B) >> np.uint32(32 - (BUCKETS.bit_length() - 1)))[~inside])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Logits by bucket (embedding times output layer), intercepts, a temperature and the score to reject below.

    And, by language, what its subwords are like: the log share of each bucket, its mean over the language's texts, and
    the variance around that of a subword and of a text. A text is as strange as its mean lies below, in deviations.
    """

    languages: list[str]
    table: np.ndarray
    intercept: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0
    usual: np.ndarray | None = None  # languages x BUCKETS
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # languages x (of a subword, of a text)
    strange: float = -np.inf

    def familiarity(self, own: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How far texts of n subwords, whose mean log share in language k is own, lie from what k is like."""
        return (own - self.mean[k]) / np.sqrt(self.spread[k, 1] + self.spread[k, 0] / np.maximum(n, 1))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The likeliest language, its probability, and whether it's rejected; UNKNOWN, 0 and rejected without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        buckets = subwords(text)
        n = max(1, len(buckets))
        shares = np.bincount(buckets, minlength=BUCKETS) / n
        z = (shares @ self.table + self.intercept) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        score = float(p[k] / p.sum())
        odd = self.familiarity(shares @ self.usual[k], n, k) < self.strange
        return self.languages[k], score, bool(score < self.floor or odd)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray, languages: list[str], held: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.3, seed: int = 7) -> Model:
    """Fits on rows of average subword counts x, of n subwords; rows `held` calibrate.

    The temperature is the one of a grid with the least log loss on the held rows. The floor of the score lies halfway
    from chance to the score below which REJECTED of them lie (half at most), and that of familiarity MARGIN beyond the
    one below which REJECTED lie: held rows are few, so their tail alone would reject some texts of known languages.
    Texts of other languages and noise score as high as any, but lie far below the second floor.
    """
    rng = np.random.default_rng(seed)
    k = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSION, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    fit = np.flatnonzero(~held)
    weight = 1 / np.maximum(1, np.bincount(y[fit], minlength=k))[y]
    weight = (weight * len(fit) / max(1e-9, weight[fit].sum())).astype(np.float32)
    gain = np.float32(20)  # averages are small: one bucket in thousands
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in range(0, len(order := rng.permutation(fit)), batch):
            rows = order[i : i + batch]
            a = x[rows] * gain
            h = a @ embed
            p = _softmax(h @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            back = p @ out.T
            out -= step * (h.T @ p)
            bias -= step * p.sum(axis=0)
            embed -= step * (a.T @ back)
    model = Model(languages, (gain * (embed @ out)).astype(np.float64), bias.astype(np.float64))
    if k and held.any():
        z = x[held].astype(np.float64) @ model.table + model.intercept
        losses = []
        for t in np.geomspace(0.05, 5, 60):
            p = _softmax(z / t)
            losses.append((-np.log(np.maximum(1e-12, p[np.arange(len(z)), y[held]])).mean(), t))
        model.temperature = float(min(losses)[1])
        p = _softmax(z / model.temperature).max(axis=1)
        model.floor = float((1 / k + min(0.5, np.quantile(p, REJECTED))) / 2)
    if k:
        _learn_usual(model, x, y, n, held)
    return model


def _learn_usual(model: Model, x: np.ndarray, y: np.ndarray, n: np.ndarray, held: np.ndarray) -> None:
    k = len(model.languages)
    model.usual, model.mean, model.spread = np.zeros((k, BUCKETS)), np.zeros(k), np.zeros((k, 2))
    for i in range(k):
        rows = np.flatnonzero(~held & (y == i))
        share = x[rows].mean(axis=0, dtype=np.float64)
        own = np.log((share + UNSEEN / BUCKETS) / (1 + UNSEEN))
        model.usual[i], model.mean[i] = own, (share * own).sum()
        one = (share * (own - model.mean[i]) ** 2).sum()
        model.spread[i] = one, max(1e-4, ((x[rows] @ own - model.mean[i]) ** 2 - one / np.maximum(n[rows], 1)).mean())
    check = held if held.any() else np.ones(len(y), bool)
    own = np.einsum("ij,ij->i", x[check], model.usual[y[check]])
    model.strange = float(min(LEAST_STRANGE, MARGIN * np.quantile(model.familiarity(own, n[check], y[check]), REJECTED)))


def rejected(model: Model, texts: list[str | None]) -> float:
    """Share of texts that a model rejects."""
    return sum(model.predict(t)[2] for t in texts) / max(1, len(texts))


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from rows where `learn` holds and text and lang are there: about `sample` documents of each language.

    Rows are chosen by a hash of their id and text against the language's count, so an id that many rows share isn't
    taken or left whole, and the row of the least hash is always taken, so that each language has a row. They are reduced to subword counts on the executors: what comes to the driver is
    bounded by MOST (or LEAST x languages) x BUCKETS, however long the texts. Every language found is learned. Every
    fifth sampled document is held for calibration, unless its language has no other.
    """
    spark = docs.sparkSession
    rows = docs.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    places = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id", "text")).alias("first")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    sample = min(sample, max(LEAST, MOST // len(languages)))
    shares = spark.createDataFrame([(r["lang"], float(sample / r["n"]), r["first"]) for r in counts], "lang string, _share double, _first long")
    chosen = rows.join(F.broadcast(shares), "lang").where((places < F.col("_share")) | (F.xxhash64("doc_id", "text") == F.col("_first"))).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(text: str) -> bytes:
            counts = np.bincount(subwords(text), minlength=BUCKETS)
            return (counts / max(1, counts.sum())).astype(np.float16).tobytes() + int(counts.sum()).to_bytes(8, "little")

        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            cuts = []
            for t in texts:
                words = t.split()
                at = len(words) // 3
                cuts.append(" ".join(words[at : at + EXCERPT]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(packed, texts), pa.binary()), pa.array(map(packed, cuts), pa.binary())], ["doc_id", "lang", "whole", "part"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = chosen.mapInArrow(run, f"doc_id {kind}, lang string, whole binary, part binary").toLocalIterator()
    taken = dict.fromkeys(languages, 0)
    some = []
    for r in got:  # about `sample` a language; equal rows fall together, and twice as many are the bound
        if taken[r["lang"]] < 2 * sample:
            taken[r["lang"]] += 1
            some.append((str(r["doc_id"]), r["lang"], bytes(r["whole"]), bytes(r["part"])))
    got = sorted(some)
    number = {name: k for k, name in enumerate(languages)}
    parts = [c for r in got for c in r[2:]]
    x = np.frombuffer(b"".join(c[:-8] for c in parts), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    n = np.array([int.from_bytes(c[-8:], "little") for c in parts])
    y = np.repeat([number[r[1]] for r in got], 2)
    held = np.repeat(np.arange(len(got)) % 5 == 4, 2)
    held &= np.isin(y, y[~held])
    return train(x, y, n, languages, held)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, from its whole text alone.

    Null, empty and letterless texts are UNKNOWN with score 0 and rejected; others carry a learned language and its
    calibrated probability, and are rejected below the model's floor or if they are strange: unlike the texts of that
    language, as noise and other languages are. Without any labelled row all is UNKNOWN. Repeated
    rows get equal results; extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            names, scores, out = zip(*[m.predict(t.as_py()) for t in batch.column(1)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that identify() does not reject, all columns unchanged."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([not m.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
