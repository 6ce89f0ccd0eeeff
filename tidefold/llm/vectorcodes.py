"""Vector codes: parts of integer vectors replaced by the number of the nearest entry of a learned codebook.

Nearest entries are screened by a float32 matrix product whose rounding errors are bounded; what the bounds can't decide
is worked out again in int64, and ties go to the lower number. So all results are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Squared distances of whole vectors stay below this, so that they fit int64: it bounds components by their number.
FARTHEST = 1 << 63
#: Components that are compared in int64 at once, at most: it bounds the rows that are screened together.
BLOCK = 1 << 23
#: Labels whose sums are broadcast at most (some 50 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 100_000
_UNIT = 2.0**-24


@dataclass
class Codebooks:
    """Integer entries by part: parts x entries x components of a part."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, embedding: str) -> DataFrame:
    """Rows whose vector is there and holds neither null nor non-finite components.

    array_contains() is null, not false, for what it doesn't find beside a null, so such rows go too.
    """
    v = F.col(embedding)
    odd = [F.lit(float(x)).cast(vectors.schema[embedding].dataType.elementType) for x in ("nan", "inf", "-inf")]
    return vectors.where(v.isNotNull() & ~F.array_contains(v, odd[0]) & ~F.array_contains(v, odd[1]) & ~F.array_contains(v, odd[2]))


def integers(column: pa.Array, width: int | None, scale: int) -> np.ndarray:
    """Rows of floor(scale x component) as int64; an error for vectors of another width or components out of range.

    Those of 64 components may reach 2^27, so 131,072 at a scale of 1,024.
    """
    lengths = np.diff(column.offsets.to_numpy())
    if width is None:
        width = int(lengths[0]) if len(lengths) else 0
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} components are wanted, there are some of {int(lengths[lengths != width][0])}")
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and 4 * width * int(np.abs(x).max()) ** 2 >= FARTHEST:
        raise ValueError(f"a component of {np.abs(x).max() / scale:g} is too large: squared distances of {width} components of that size don't fit 64 bits")
    return x.astype(np.int64).reshape(len(column), width)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each row, the lowest of equals, and the squared distance; both exact.

    Rounded to float32 (two roundings a product), a sum of d products is off by at most (d + 2) u / (1 - (d + 2) u) times
    the norms' product (u = 2^-24), in any order of summing, fused or not. Adding the entry's squared norm, itself
    rounded, costs less than 4 u of what is added. Entries whose score may, by these bounds, be the least are compared in int64.
    """
    n, d = x.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not d:
        return code, error
    e32 = entries.astype(np.float32)
    square = (entries * entries).sum(axis=1)
    longest = float(np.sqrt(square.max())) * (1 + 1e-9)
    share = (d + 2) * _UNIT / (1 - (d + 2) * _UNIT)
    rows = max(1, BLOCK // entries.size)
    for at in range(0, n, rows):
        block = x[at : at + rows]
        score = square.astype(np.float32) - 2 * (block.astype(np.float32) @ e32.T)
        norm = np.sqrt((block * block).sum(axis=1).astype(np.float64)) * (1 + 1e-9)
        off = 2 * share * norm * longest + 4 * _UNIT * (longest * longest + 2 * norm * longest)
        open_ = score <= (score.min(axis=1).astype(np.float64) + 2.001 * off)[:, None]
        row, entry = np.nonzero(open_)
        exact = ((block[row] - entries[entry]) ** 2).sum(axis=1)
        first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
        least = np.minimum.reduceat(exact, first)
        best = np.where(exact == np.repeat(least, np.diff(np.append(first, len(row)))), entry, len(entries))
        code[at : at + rows], error[at : at + rows] = np.minimum.reduceat(best, first), least
    return code, error


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances summed over parts."""
    parts, _, d = books.shape
    found = [nearest(x[:, p * d : (p + 1) * d], books[p]) for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def _first(vectors: DataFrame, vec_id: str, embedding: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids: the ids alone are looked for first, then their vectors."""
    whole = kept(vectors, embedding)
    ids = [r[0] for r in whole.where(F.col(vec_id).isNotNull()).select(vec_id).orderBy(vec_id).limit(entries).collect()]
    few = whole if len(ids) < entries else whole.where(F.col(vec_id) <= F.lit(ids[-1]))
    rows = few.orderBy(F.col(vec_id).asc_nulls_last(), F.col(embedding)).limit(entries).select(embedding).toArrow().column(0).combine_chunks()
    if not len(rows):
        return None
    x = integers(rows, None, scale)
    if x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components can't be cut into {parts} equal parts")
    return Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)))


def _sums(vectors: DataFrame, embedding: str, books: Codebooks, scale: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): rows of each entry and their componentwise sums, summed in each task first."""
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
    parts, k, d = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            x = integers(batch.column(0), parts * d, scale)
            if not len(x):
                continue
            codes, _ = assign(x, shared.value)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                found, at = np.unique(codes[order, p], return_index=True)
                n[p, found] += np.diff(np.append(at, len(x)))
                total[p, found] += np.add.reduceat(x[order, p * d : (p + 1) * d], at, axis=0)
        p, e = np.nonzero(n)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[p, e].ravel()), d).cast(pa.list_(pa.int64())) if d else pa.array([[]] * len(p), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), sums], ["part", "entry", "n", "sums"])

    each = kept(vectors, embedding).select(embedding).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)


def learn(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks of all kept vectors: they start as the parts of the smallest ids and move to the floored means of theirs.

    Every round looks at every vector; tasks send one sum for each entry, so parts x entries rows come to the driver.
    Entries that nothing is nearest to stay. Rows that share an id count one by one (equal ids by vector, null ids
    last). Fewer vectors than entries give as many entries; none at all give None.
    """
    books = _first(vectors, vec_id, embedding, parts, entries, scale)
    for _ in range(rounds if books else 0):
        moved = books.entries.copy()
        for r in _sums(vectors, embedding, books, scale).collect():
            moved[r["part"], r["entry"]] = [int(s) // r["n"] for s in r[3:]]
        books = Codebooks(moved)
    return books


def encode(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, others: dict[str, Column] | None = None) -> DataFrame:
    """(vec_id, code binary, error long, and other columns) of every kept vector: a byte a part, two beyond 256 entries."""
    shared = vectors.sparkSession.sparkContext.broadcast(books.entries)
    rows = kept(vectors, embedding).select(F.col(embedding).alias("embedding"), F.col(vec_id).alias("vec_id"), *[c.alias(k) for k, c in (others or {}).items()])
    parts, k, d = books.entries.shape
    kind = np.uint8 if k <= 256 else np.dtype(">u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = assign(integers(batch.column(0), parts * d, scale), shared.value)
            packed = codes.astype(kind)
            size = packed.itemsize * parts
            data = packed.tobytes()
            code = pa.array([data[i : i + size] for i in range(0, len(data), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], code, pa.array(error)], [*names, "code", "error"])

    names = rows.columns[1:]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(run, ", ".join([*kinds, "code binary", "error long"]))


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector, code and digest in lowercase hex.

    Vectors that are null or hold null or non-finite components are left out. label_error is the error of all vectors of
    equal label, nulls together; a label may have any number of rows. Repeated rows stay and get equal codes; null ids
    and labels stay; an empty table gives no rows; extra columns are not read. Vectors of several widths, a width that
    isn't a multiple of `parts`, and components whose squared distances don't fit 64 bits are errors.
    """
    spark = vectors.sparkSession
    books = learn(vectors, vec_id, embedding, parts, entries, rounds, scale)
    kind = vectors.schema[vec_id].dataType.simpleString()
    if books is None:
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    found = cut(encode(vectors, books, vec_id, embedding, scale, {"label": F.col(label)}), "codes")
    sums = cut(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums.hint("merge")
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
