from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from conftest import FAILS
from pyspark.sql import functions as F

from tidefold.llm import vectorcodes

KIND = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Python: every part against every entry, in whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    ints = [[math.floor(scale * float(np.float32(c))) for c in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))
    d = len(ints[0]) // parts if ints else 0
    cut = lambda i, p: ints[i][p * d : (p + 1) * d]
    books = [[cut(i, p) for i in order[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for i in range(len(ints)):
                own.setdefault(near(cut(i, p), books[p])[1], []).append(cut(i, p))
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if e in own else y for e, y in enumerate(books[p])]
    found = [[near(cut(i, p), books[p]) for p in range(parts)] for i in range(len(ints))]
    error = [sum(f[0] for f in x) for x in found]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{f[1]:02x}" for f in x), e, by_label[r[2]], digest) for r, x, e in zip(kept, found, error, strict=True)), key=str)


def ran(spark, rows, **more):
    df = spark.createDataFrame([(*r, "own") for r in rows], KIND).repartition(5)
    return sorted((tuple(r) for r in vectorcodes.compress(df, **more).collect()), key=str)


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(c) for c in rng.normal(0, 0.3, 8)], int(i % 3) if i % 7 else None) for i in rng.permutation(60)]
    assert ran(spark, rows, entries=16) == brute(rows, entries=16)


def test_nulls_copies_ties_and_odd_numbers(spark):
    rng = np.random.default_rng(1)
    near = [[float(c) / 1024 for c in rng.integers(-2, 3, 8)] for _ in range(80)]
    rows = [(i // 2, v, i % 2) for i, v in enumerate(near)]  # shared ids, many equal distances
    rows += [(None, near[0], None), (None, near[0], 5), (3, near[1], 1), (3, near[1], 1)]
    rows += [(90, None, 1), (91, [float("nan"), *near[0][1:]], 1), (92, [*near[0][:-1], float("-inf")], 1), (93, [None, *near[0][1:]], 1), (-1, [None] * 8, 1)]
    assert ran(spark, rows, entries=12) == brute(rows, entries=12)
    assert ran(spark, rows[:3]) == brute(rows[:3])  # fewer vectors than entries
    assert ran(spark, [(1, None, 1)]) == ran(spark, []) == []


def test_screening_is_exact_where_float32_is_not():
    """Large numbers, close entries and equal ones: float32 alone goes wrong, the bounds send these to int64."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-(1 << 26), 1 << 26, 16)
    entries = middle + rng.integers(-3, 4, (256, 16))
    entries[200:] = entries[:56]
    x = middle + rng.integers(-3, 4, (500, 16))
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    code, error = vectorcodes.nearest(x, entries)
    assert np.array_equal(code, exact.argmin(axis=1)) and np.array_equal(error, exact.min(axis=1))
    plain = ((entries.astype(np.float32) ** 2).sum(axis=1) - 2 * (x.astype(np.float32) @ entries.astype(np.float32).T)).argmin(axis=1)
    assert (plain != code).any()


def test_hot_label_without_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 1, 4)], 0 if i % 3 else i) for i in range(90)]
    want = brute(rows, entries=8)
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", 1)
    assert ran(spark, rows, entries=8) == want


def test_wide_codes_and_double_vectors(spark):
    rows = [(i, [i / 7, -i / 3], 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = vectorcodes.learn(df, parts=2, entries=300, rounds=1)
    got = vectorcodes.encode(df, books).select("vec_id", F.hex("code").alias("c")).collect()
    assert books.entries.shape == (2, 300, 1) and {len(r.c) for r in got} == {8}
    assert sorted((r.vec_id, int(r.c[:4], 16)) for r in got)[299] == (299, 299)


@pytest.mark.parametrize("vectors", [[[0.0] * 4, [0.0] * 8], [[0.0] * 6], [[1e9] * 4, [0.0] * 4]])
def test_what_cannot_be_coded_is_an_error(spark, vectors):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    with pytest.raises((*FAILS, ValueError)):
        vectorcodes.compress(df).collect()
