from __future__ import annotations

import numpy as np
import pytest
from conftest import FAILS
from pyspark.sql import functions as F

from tidefold.operators import decoding
from tidefold.plans import queries

SF = "/root/testdata/sf0.001"


def cells(spark, rng, sizes, d=5, kinds=2):
    rows = []
    for k, n in enumerate(sizes):
        w = rng.normal(size=d)
        for role, m in (("train", n), ("test", n // 2 + 2)):
            x = rng.normal(size=(m, d))
            y = np.digitize(x @ w + rng.normal(size=m), np.linspace(-1, 1, kinds - 1) if kinds > 2 else [0.0])
            y[:kinds] = np.arange(kinds)[: len(y)]
            rows += [(f"c{k}", role, i, int(v), [float(c) for c in r]) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "cell string, role string, item int, label int, features array<double>").repartition(6)


@pytest.mark.parametrize(("kinds", "d"), [(2, 5), (4, 3), (2, 40)])
def test_stacked_cells_equal_cells_apart(spark, kinds, d):
    rng = np.random.default_rng(kinds * d)
    df = cells(spark, rng, [*rng.integers(8, 70, 40).tolist(), 300], d, kinds)
    want = {r.cell: r for r in decoding.decode_cells(df, ["cell"]).collect()}
    for rack in (50_000, 500):
        got = {r.cell: r for r in decoding.decode_many(df, ["cell"], rack=rack).collect()}
        assert got.keys() == want.keys() and len(got) == 41
        for k, r in want.items():
            assert abs(got[k].test_auroc - r.test_auroc) < 1e-9 and abs(got[k].train_auroc - r.train_auroc) < 1e-9
            assert (got[k].n_train, got[k].n_test, got[k].n_features) == (r.n_train, r.n_test, r.n_features)
            assert d == 40 or got[k].n_iter == r.n_iter


def test_padding_and_early_stops():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 30, 4)), (rng.random((6, 30)) > 0.5).astype(float)
    used = (np.arange(30) < np.array([30, 29, 20, 12, 11, 30])[:, None]).astype(float)
    for tol in (1e-3, 1e-8):
        w, b, steps = decoding.fit_many(x, y, used, tol=tol)
        for k in range(6):
            own = used[k] > 0
            one, intercept, n = decoding.fit_logistic(x[k][own], y[k][own], tol=tol)
            assert np.allclose(w[k], one, atol=1e-10) and abs(b[k] - intercept) < 1e-10 and steps[k] == n


def test_errors_name_the_cell(spark):
    df = cells(spark, np.random.default_rng(1), [20, 20])
    odd = F.when((F.col("cell") == "c1") & (F.col("item") == 3), F.array(*[F.lit(float("inf"))] * 5)).otherwise(F.col("features"))
    with pytest.raises(FAILS, match="c1.*: 5 non-finite train feature values"):
        decoding.decode_many(df.withColumn("features", odd), ["cell"]).collect()
    with pytest.raises(FAILS, match="c0.*: no test rows"):
        decoding.decode_many(df.where("cell = 'c1' or role = 'train'"), ["cell"]).collect()
    assert decoding.decode_many(df.limit(0), ["cell"]).count() == 0


def test_gradients_alone_reach_what_hessians_do(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(300, 12)), rng.normal(size=(12, 3))
    rows = [("train" if i % 3 else "test", int(np.argmax(r @ w + rng.normal(size=3))), [float(c) for c in r * (1 + 9 * (np.arange(12) == 4))]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "role string, label int, features array<double>").repartition(5)
    by = lambda **more: {r.task: r for r in decoding.decode_labels(df, **more).collect()}
    want, got, loose = by(), by(wide=1), by(wide=1, tol=1e-3)
    for k, r in want.items():
        assert abs(got[k].test_auroc - r.test_auroc) < 1e-9 and abs(got[k].train_auroc - r.train_auroc) < 1e-9
        assert r.n_iter < got[k].n_iter < 60 and 0 < loose[k].n_iter < got[k].n_iter and abs(loose[k].test_auroc - r.test_auroc) < 0.02


def test_twenty_thousand_features(spark):
    """More features than a Hessian could have; equal to the plain solver, which works in the span of the rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 20_000))
    y = (x[:, :50].sum(axis=1) > 0).astype(int)
    rows = [("train" if i < 40 else "test", int(y[i]), x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "role string, label int, features array<double>").repartition(4)
    got = {r.task: r for r in decoding.decode_labels(df).collect()}
    z = (x - x[:40].mean(axis=0)) / x[:40].std(axis=0)
    w, b, _ = decoding.fit_logistic(z[:40], y[:40].astype(float))
    assert got[1].n_features == 20_000 and abs(got[1].test_auroc - decoding.rank_auroc(z[40:] @ w + b, y[40:])) < 1e-9


@pytest.mark.parametrize("name", ["small_models", "two_tolerances"])
def test_queries_equal_cells_apart(spark, name):
    rows = queries._timed(spark, SF)
    keys = ["test_subject", "test_trial", "task", "fold"]
    # cells of one class have no area
    want = {tuple(r[k] for k in keys): r.test_auroc for r in decoding.decode_cells(rows, keys, tol=1e-8 if name == "small_models" else 1e-6).collect()}
    got = {tuple(r[k] for k in keys): r for r in queries.QUERIES[name](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        a = r.test_auroc if name == "small_models" else r.auroc_tight
        none = lambda v: v is None or np.isnan(v)
        assert none(a) == none(want[k]) and (none(a) or abs(a - want[k]) < 1e-6)
