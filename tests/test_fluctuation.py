from __future__ import annotations

import numpy as np
import pytest
from conftest import FAILS
from pyspark.sql import functions as F

from tidefold.functions.columns import geometric_scales, longest_run
from tidefold.model import Q_ALL
from tidefold.operators import features, fluctuation
from tidefold.plans import arrays
from tidefold.sources.synthetic import fgn

SCALES = [8, 11, 15, 21, 28, 39, 53, 64]


def frame(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "window int, samples array<double>")


def test_published_scales():
    # Fixed values
    assert geometric_scales(2048) == [8, 11, 15, 21, 28, 39, 53, 73, 99, 136, 187, 256]
    assert geometric_scales(2048, largest=128) == [8, 10, 13, 17, 22, 28, 36, 47, 60, 77, 99, 128]
    assert geometric_scales(2048, largest=512) == [8, 12, 17, 25, 36, 53, 77, 113, 165, 240, 351, 512]


def brute_hurst(x):
    """Slope of the RMS that straight lines leave, one segment at a time."""
    y, f = np.cumsum(x - np.mean(x)), []
    for s in SCALES:
        t, rms = np.arange(s), []
        for k in range(len(x) // s):
            part = y[k * s : (k + 1) * s]
            rms.append(np.sqrt(np.mean((part - np.polyval(np.polyfit(t, part, 1), t)) ** 2)))
        f.append(np.sqrt(np.mean(np.maximum(rms, 1e-3 * np.median(rms)) ** 2)))
    return np.polyfit(np.log2(SCALES), np.log2(f), 1)[0]


def test_expressions_equal_polynomial_fits(spark):
    rng = np.random.default_rng(5)
    xs = [*rng.standard_normal((4, 512)).cumsum(axis=1), *rng.standard_normal((4, 512)), 1e-5 * fgn(512, 0.6, 1)]
    got = fluctuation.mfdfa_expressions(frame(spark, xs), SCALES, Q_ALL).orderBy("window").collect()
    want = fluctuation.exponents(np.array(xs), SCALES, Q_ALL, 1)
    line = [brute_hurst(x) for x in xs]
    assert np.abs(want[:, Q_ALL.index(2.0)] - line).max() < 1e-9
    assert np.abs(np.array([r.hq for r in got]) - want).max() < 1e-9
    assert np.abs(np.array([r.hurst for r in got]) - want[:, Q_ALL.index(2.0)]).max() < 1e-9
    other = fluctuation.mfdfa(frame(spark, [*xs, xs[0][:300], []]), SCALES, Q_ALL).orderBy("window").collect()
    assert np.abs(np.array([r.hq for r in other[:-2]]) - want).max() < 1e-12
    for a, b in zip(got, other, strict=False):
        assert np.abs(np.array(a.fluct_q) - np.array(b.fluct_q)).max() < 1e-9 and np.abs(np.array(a.fluct) - np.array(b.fluct)).max() < 1e-9
    assert other[-1].hq == [None] * len(Q_ALL) and other[-2].hurst is not None


@pytest.mark.parametrize("order", [1, 2, 3])
def test_exponents_do_not_depend_on_amplitude(order):
    xs = np.array([fgn(512, h, k) for k, h in enumerate((0.3, 0.5, 0.7, 0.9))])
    a, b = (fluctuation.exponents(x, SCALES, (1.0, 2.0, 5.0), order) for x in (xs, 3.7e4 * xs - 11))
    assert np.abs(a - b).max() < 1e-9


def test_floor_binds_on_plateaus(spark):
    x = fgn(512, 0.5, 3)
    x[100:164] = x[100]
    clean = fgn(512, 0.5, 4)
    width = lambda rows: [r.hq[0] - r.hq[1] for r in rows]
    floored = width(fluctuation.mfdfa(frame(spark, [x, clean]), SCALES, (-5.0, 5.0)).orderBy("window").collect())
    bare = width(fluctuation.mfdfa(frame(spark, [x, clean]), SCALES, (-5.0, 5.0), rel_floor=0.0).orderBy("window").collect())
    assert floored[1] < 0.5 and abs(floored[1] - bare[1]) < 1e-9 and abs(bare[0]) > abs(floored[0])
    runs = fluctuation.flat_run(frame(spark, [x, clean])).orderBy("window").collect()
    assert [r.run for r in runs] == [64, 1]


def test_scales_beyond_the_window(spark):
    got = fluctuation.mfdfa(frame(spark, [fgn(256, 0.5, 1)]), [8, 16, 32, 64, 128, 512], (2.0,)).first()
    assert got.fluct[-1] is None and None not in got.fluct[:-1] and got.hurst is not None
    assert fluctuation.mfdfa(frame(spark, [[]]), [8, 16], (2.0,)).first().hurst is None


def test_guards(spark):
    with pytest.raises(FAILS, match="non-finite"):
        fluctuation.dfa(frame(spark, [[1.0, float("nan")] * 20]), [8, 16]).collect()
    for scales in ([], [3, 8]):
        with pytest.raises(ValueError):
            fluctuation.hq_of_order(frame(spark, [[1.0] * 40]), scales, order=2)


def test_longest_run_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    xs = [[], [1.0], *rng.integers(0, 3, (30, 40)).astype(float)]
    got = frame(spark, xs).withColumn("r", longest_run(F.col("samples"))).orderBy("window").collect()
    for x, r in zip(xs, got, strict=True):
        best = run = 1
        for a, b in zip(x, list(x)[1:], strict=False):
            run = run + 1 if a == b else 1
            best = max(best, run)
        assert r.r == best


def test_features(spark):
    x = np.array([[1.0, 2.0, 4.0, 9.0], [2.0, 2.0, 2.0, 2.0], [0.0, 0.0, 0.0, 0.0]])
    got = frame(spark, x).select(features.log_variance("samples", "nan").alias("v"), features.shape_only("samples", "nan").alias("s")).collect()
    assert got[0].v == pytest.approx(np.log(x[0].var())) and np.isnan(got[1].v)
    assert got[0].s == pytest.approx(list(x[0] / 16)) and all(map(np.isnan, got[2].s))
    for column, what in ((features.log_variance("samples"), "zero variance"), (features.shape_only("samples"), "no mass")):
        with pytest.raises(FAILS, match=what):
            frame(spark, x).select(column).collect()
    with pytest.raises(FAILS, match="2 non-finite test values"):
        frame(spark, [[1.0, float("nan"), float("inf")]]).select(features.refuse_non_finite("samples", "test")).collect()


def test_windows_are_cut_from_traces(spark):
    traces = spark.createDataFrame([(1, "e", [float(i) for i in range(100)])], "session int, electrode string, trace array<double>")
    starts = spark.createDataFrame([(1, 5), (1, 90), (1, 5)], "session int, window_from long")
    got = features.gather(traces, starts, ["session"], 10).orderBy("window_from").collect()
    assert [r.samples for r in got] == [[float(i) for i in range(a, a + 10)] for a in (5, 90)]
    with pytest.raises(FAILS, match="leaves its trace"):
        features.gather(traces, spark.createDataFrame([(1, 91)], "session int, window_from long"), ["session"], 10).collect()


def test_spectrum_of_a_tone(spark):
    x = np.sin(2 * np.pi * 64 * np.arange(2048) / 2048)
    got = np.array(features.spectrogram(frame(spark, [x])).first().spec)
    assert got.shape == (17, 38) and (got[3:-3].argmax(axis=1) == 16).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_signals_in_chunks_equal_whole_ones(spark, order):
    """Chunks of any length, in any order, shorter and longer than segments."""
    rng = np.random.default_rng(order)
    scales, q = [8, 13, 40, 128, 333, 5000], (-5.0, 0.0, 1.0, 2.0, 3.0)
    signals = {"noise": fgn(2000, 0.7, 1), "walk": 1e3 + np.cumsum(fgn(1500, 0.3, 2)), "flat": np.repeat(fgn(20, 0.5, 3), 50), "short": fgn(9, 0.5, 4), "tiny": fgn(3, 0.5, 4)}
    rows = []
    for k, x in signals.items():
        cuts = np.unique(np.r_[0, rng.integers(1, len(x), 12), len(x)])
        rows += [(k, int(a), x[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] + [(k, len(x), [])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, int(a), list(map(float, x))) for k, a, x in rows], "k string, chunk_from long, trace array<double>").repartition(5)
    got = {r.k: r for r in fluctuation.mfdfa_chunks(df, ["k"], scales, q, order=order).collect()}
    whole = spark.createDataFrame([(k, x.tolist()) for k, x in signals.items()], "k string, samples array<double>")
    want = {r.k: r for r in fluctuation.mfdfa(whole, scales, q, order=order).collect()}
    assert got.keys() == want.keys()
    near = lambda a, b, rel=1e-9: (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=rel, abs=rel))
    for k, w in want.items():
        g = got[k]
        if k == "flat":  # most segments of plateaus leave nothing but rounding, which low powers show
            assert all(near(x, y, 1e-6) for x, y in zip([*g.fluct, g.hurst], [*w.fluct, w.hurst], strict=True))
        else:
            assert all(near(x, y) for x, y in zip([*g.fluct, *sum(g.fluct_q, []), *g.hq, g.hurst], [*w.fluct, *sum(w.fluct_q, []), *w.hq, w.hurst], strict=True)), k


def test_chunks_that_are_no_signal(spark):
    for rows, what in (([(0, [1.0] * 10), (11, [2.0] * 9)], "follow each other"), ([(0, [1.0] * 10), (5, [2.0] * 9)], "follow each other"), ([(3, [1.0] * 10)], "follow each other"), ([(0, [1.0, float("nan")] * 10)], "non-finite values")):
        df = spark.createDataFrame(rows, "chunk_from long, trace array<double>")
        with pytest.raises(FAILS, match=what):
            fluctuation.mfdfa_chunks(df, [], [4, 8]).collect()
    assert fluctuation.mfdfa_chunks(spark.createDataFrame([("k", 0, None)], "k string, chunk_from long, trace array<double>"), ["k"], [8]).count() == 0


def test_recordings_of_a_query_equal_whole_signals(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    for r in arrays.exponents_of_recordings(spark, "/root/testdata/sf0.001").collect():
        x = np.concatenate([np.asarray(e.embedding, float) for e in v if e.label == r.label])
        h = fluctuation.exponents(x[None], [8, 16, 32, 64, 128, 256], (-3.0, 0.0, 2.0, 3.0), 2)[0]
        assert r.hq == pytest.approx(h, abs=2e-6) and r.hurst == pytest.approx(h[2], abs=2e-6)


@pytest.mark.parametrize(("block", "order"), [(1, 1), (100, 2), (700, 1), (1 << 13, 2)])
def test_chunks_joined_to_blocks_equal_whole_windows(spark, block, order):
    """Signals of one block and of many; numpy gets a row a block, not a row a chunk."""
    rng = np.random.default_rng(block)
    signals = {k: fgn(n, 0.6, k) for k, n in enumerate((2000, 700, 701, 90, 7))}
    rows = [(k, a, x[a : a + 7].tolist()) for k, x in signals.items() for a in range(0, len(x), 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(k), int(a), list(map(float, x))) for k, a, x in rows], "k int, chunk_from long, trace array<double>").repartition(5)
    assert fluctuation.blocks_of(df, ["k"], block=block).count() == sum(-(-len(x) // 7) if block == 1 else len({a // block for a in range(0, len(x), 7)}) for x in signals.values())
    scales, q = [8, 16, 60, 250], (-3.0, 0.0, 2.0)
    got = {r.k: r for r in fluctuation.mfdfa_chunks(df, ["k"], scales, q, order=order, block=block).collect()}
    for k, x in signals.items():
        want = fluctuation.exponents(x[None], scales, [*q, 2.0], order)[0]
        assert [np.nan if v is None else v for v in (*got[k].hq, got[k].hurst)] == pytest.approx(want.tolist(), rel=1e-9, nan_ok=True), k
    assert len(got) == len(signals)


def test_a_long_recording_is_a_few_blocks(spark):
    x = fgn(20_000, 0.7, 11)
    df = spark.createDataFrame([(a, x[a : a + 64].tolist()) for a in range(0, len(x), 64)], "chunk_from long, trace array<double>").repartition(3)
    assert fluctuation.blocks_of(df, []).count() == 3
    got = fluctuation.mfdfa_chunks(df, [], (8, 32, 256, 5000), (-3.0, 3.0), order=2).first()
    want = fluctuation.exponents(x[None], (8, 32, 256, 5000), (-3.0, 3.0, 2.0), 2)[0]
    assert [*got.hq, got.hurst] == pytest.approx(want.tolist(), rel=1e-9)
