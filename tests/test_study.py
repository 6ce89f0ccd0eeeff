from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from conftest import FAILS
from pyspark.sql import functions as F

from tidefold.functions import columns, ranks
from tidefold.operators import decoding, features, fluctuation, fold_audit, inference, selection, timescale
from tidefold.plans import adapters as A
from tidefold.plans import study
from tidefold.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_every_key_has_features(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "k int, v string")
    known = spark.createDataFrame([(1, 0.5), (2, None)], "k int, x double")
    assert sorted(map(tuple, features.lookup_all(rows, known, ["k"]).collect())) == [(1, "a", 0.5), (1, "c", 0.5), (2, "b", None)]
    with pytest.raises(FAILS, match='no features for {"k":2}'):
        features.lookup_all(rows, known.where("k = 1"), ["k"]).collect()


def test_channels_need_every_window(spark):
    rng = np.random.default_rng(0)
    windows = spark.createDataFrame([(1, e, w, [float(v) for v in rng.standard_normal(3) + 3 * (w % 2)]) for e in "xy" for w in range(40)], "session int, electrode string, window_from int, samples array<double>")
    folds = spark.createDataFrame([(1, "t", 0, "train" if i < 20 else "test", i, i % 2, i) for i in range(40)], "session int, task string, fold int, role string, item int, label int, window_from int")
    got = decoding.decode_channels(windows, folds, ["session"]).collect()
    assert {r.electrode for r in got} == {"x", "y"} and all(r.test_auroc > 0.9 and r.n_train == 20 for r in got)
    with pytest.raises(FAILS, match="no features"):
        decoding.decode_channels(windows.where("not (electrode = 'y' and window_from = 7)"), folds, ["session"]).collect()


def test_cells_have_one_source(spark):
    rows = [(1, 1, "t", 0, "train", 1, 1), (1, 1, "t", 0, "train", 1, 1), (1, 1, "t", 0, "test", 1, 2), (1, 1, "t", 0, "val", 9, 9)]
    kind = "test_subject int, test_trial int, task string, fold int, role string, src_subject int, src_trial int"
    got = fold_audit.single_source(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.role, r.src_subject, r.src_trial) for r in got) == [("test", 1, 2), ("train", 1, 1)]
    with pytest.raises(FAILS, match="several source sessions"):
        fold_audit.single_source(spark.createDataFrame([*rows, (1, 1, "t", 0, "test", 1, 3)], kind)).collect()


def test_lists_of_sessions(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (10, 0), (None, 1)], "subject int, trial int")
    assert sorted(map(tuple, selection.only_sessions(rows, ["1_1", "s10_t0"]).collect())) == [(1, 1), (10, 0)]
    assert selection.only_sessions(rows, []).count() == 0
    with pytest.raises(ValueError, match="x_1"):
        selection.only_sessions(rows, ["x_1"])


def test_extraction_tells_undefined_windows(spark):
    flat, wave = [2.0] * 64, [math.sin(i) + 0.01 * i * i for i in range(64)]
    traces = spark.createDataFrame([(1, "a", flat), (1, "b", wave), (2, "a", flat[:32] + wave[:32])], "session int, electrode string, trace array<double>")
    starts = spark.createDataFrame([(1, 0), (1, 16), (2, 16), (1, 16)], "session int, window_from int")
    rows = features.extract(traces, starts, ["session"], (8, 10, 12), (1.0, 2.0), 48, fs=48.0, window=16, max_hz=24.0)
    got = {(r.session, r.electrode, r.window_from): r for r in rows.collect()}
    assert len(got) == 5
    for (session, electrode, start), r in got.items():
        constant = (session, electrode) == (1, "a")
        assert math.isnan(r.log_var) == constant and all(math.isnan(h) == constant for h in r.hq) and (r.run == 48) == constant
        if not constant:
            x = np.array({(1, "b"): wave, (2, "a"): flat[:32] + wave[:32]}[session, electrode][start : start + 48])
            assert r.log_var == pytest.approx(np.log(x.var()))
            assert r.hq == pytest.approx(fluctuation.exponents(x[None], (8, 10, 12), (1.0, 2.0), 1)[0])
            taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
            assert r.spec[4] == pytest.approx(np.abs(np.fft.rfft(x[8:24] * taper)) / taper.sum())
    counts = features.undefined_counts(rows, ["session"], "log_var").collect()
    assert {(r.session, r.n, r.n_undefined) for r in counts} == {(1, 4, 2), (2, 1, 0)}


def test_spectra_of_windows_of_many_lengths(spark):
    rows = spark.createDataFrame([(0, [1.0] * 32), (1, None), (2, [2.0] * 20), (3, [1.0] * 32), (4, [])], "k int, samples array<double>")
    got = {r.k: r.spec for r in features.spectrogram(rows.coalesce(1), fs=16.0, window=16, max_hz=8.0).collect()}
    assert got[1] is None and got[0] == got[3] and len(got[0]) == 9 and len(got[2]) == 6 and np.array(got[2])[2, 0] == pytest.approx(2.0)


def test_settings_of_sensitivity(spark):
    x = np.random.default_rng(1).standard_normal(2048).cumsum()
    df = spark.createDataFrame([(7, [float(v) for v in x])], "k int, samples array<double>")
    got = {(r.s_max, r.polynomial): r.hq for r in fluctuation.sensitivity(df, ["k"]).collect()}
    assert set(got) == set(fluctuation.SETTINGS)
    for (largest, order), hq in got.items():
        scales = np.unique(np.round(np.geomspace(8, largest, 12)).astype(int))
        assert hq == pytest.approx(fluctuation.exponents(x[None], scales, (1.0, 2.0, 3.0, 5.0), order)[0])


def made_cells(spark):
    rng = random.Random(3)
    rows = [(m, s, t, k, 0.5 + 0.3 * rng.random()) for m in ("a", "b") for s in (1, 2, 3) for t in (0, 1) for k in ("x", "y") if (m, s, t, k) != ("b", 2, 1, "y")]
    return rows, spark.createDataFrame(rows, "model string, subject int, trial int, task string, auroc double")


def test_whole_comparison(spark):
    rows, cells = made_cells(spark)
    got = inference.compare(cells, "a", "b", 2, "ab", 200).first()
    mean = lambda m, s, t: np.mean([r[4] for r in rows if r[:3] == (m, s, t)])
    diffs = [mean("a", s, t) - mean("b", s, t) for s in (1, 2, 3) for t in (0, 1) if (s, t) != (2, 1)]
    assert (got.comparison, got.a, got.b, got.n_sessions, got.sessions_dropped) == ("ab", "a", "b", 5, ["2_1"])
    assert got.mean_diff == pytest.approx(np.mean(diffs)) and got.ci_lo < got.mean_diff < got.ci_hi
    assert inference.compare(cells, "a", "none", 2).count() == 0
    tau = spark.createDataFrame([("y", 0.5)], "task string, tau double")
    tasks = inference.compare_tasks(cells, "a", "b", tau, resamples=100).collect()
    assert [(r.task, r.n_sessions, r.tau) for r in tasks] == [("y", 5, 0.5), ("x", 6, None)]
    again = inference.converged_minus_default(cells, cells.withColumn("auroc", F.col("auroc") + 0.125), 2, resamples=100).orderBy("model").collect()
    assert [(r.model, r.n_sessions) for r in again] == [("a", 6), ("b", 5)] and all(r["mean"] == pytest.approx(0.125) == pytest.approx(r.converged - r.default) for r in again)


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_and_numbers_equal_numpy(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(rng.choice("ab"), rng.choice([rng.gauss(0, 1), 0.0, 1e9 * rng.random(), float("nan"), None, -3.0]), i) for i in range(400)] + [("one", 2.5, 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = {r.k: r for r in ranks.quantiles(df.repartition(5), ["k"], F.col("v"), {"m": 0.5, "p": 0.95, "z": 0.0}, accuracy).collect()}
    for k in "ab":
        some = [v for g, v, _ in rows if g == k and v is not None and not math.isnan(v)]
        assert (got[k].m, got[k].p, got[k].z) == pytest.approx(tuple(np.quantile(some, [0.5, 0.95, 0.0])))
    assert got["one"].m == got["one"].p == 2.5 and got["none"].m is None
    finite = df.where("not isnan(v) or v is null")
    numbers = ranks.numbered(finite, ["k"], ("v", "i"), "n").collect()
    for k in "ab":
        mine = sorted((r for r in numbers if r.k == k), key=lambda r: (r.v is not None, r.v or 0, r.i))
        assert [r.n for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("n", [*range(1, 12), 99, 20_000])
def test_quantiles_of_every_size(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = ranks.quantiles(spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4), [], F.col("v"), at).first()
    assert tuple(got) == pytest.approx(tuple(np.quantile(x, list(at.values()))), abs=1e-12)


def test_ranges_are_even_with_outliers_nan_and_ties(spark):
    v = "case when id = 0 then 1e15 when id % 3 = 1 then double('nan') when id % 3 = 2 then 7.0 else rand(1) end"
    df = spark.range(40_000).selectExpr("'k' as k", f"{v} as v", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    try:
        sizes = [r["count"] for r in ranks.ranged(df, ["k"], ["v", "id"]).groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 40_000 and len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes)
    numbers = ranks.numbered(df, ["k"], ["v", "id"], "n")
    assert numbers.agg(F.countDistinct("n"), F.min("n"), F.max("n")).first()[:] == (40_000, 0, 39_999)
    assert numbers.where("id = 0").first().n == numbers.where("not isnan(v)").count() - 1


def test_defaults_of_maps(spark):
    got = spark.sql("select map('a', 1, 'n', cast(null as int)) as m, explode(array('a', 'b', 'n')) as k").select(columns.lookup(F.col("m"), "k", 9).alias("v")).collect()
    assert [r.v for r in got] == [1, 9, 9]


def test_later_rows_of_a_log_hold(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = lambda *xs: spark.createDataFrame(list(xs), "name string, bytes long").coalesce(1)
    writers.append_log(rows(("a", 1), ("b", 2), ("a", 3)).withColumn("downloaded_utc", F.lit("2999")), path)
    writers.append_log(writers.stamped(rows(("b", 4))), path)
    assert sorted((r.name, r.bytes) for r in readers.read_manifest(spark, path).collect()) == [("a", 3), ("b", 4)]


def test_csv_files_of_one_folder_may_differ(spark, tmp_path):
    (tmp_path / "L1.csv").write_text("test_auroc,task,n_excluded_plateau\n0.5,x,2\n")
    (tmp_path / "L2.csv").write_text("task,other,test_auroc\ny,zzz,0.75\n")
    (tmp_path / "L3.csv").write_text("task,test_auroc\n")
    got = readers.read_decoded(spark, str(tmp_path)).orderBy("task").collect()
    assert [(r.task, r.test_auroc, r.n_excluded_plateau) for r in got] == [("x", 0.5, 2), ("y", 0.75, None)]


def brute_interval(name, rows, resamples=10_000):
    """Subjects drawn with replacement, then as many sessions of each; rows are (subject, trial, difference)."""
    by = {}
    for s, _, d in sorted(rows):
        by.setdefault(s, []).append(d)
    rng, subjects, means = np.random.default_rng(zlib.crc32(name.encode())), sorted(by), []
    for _ in range(resamples):
        drawn = []
        for k in rng.integers(0, len(subjects), len(subjects)):
            own = by[subjects[k]]
            drawn += [own[i] for i in rng.integers(0, len(own), len(own))]
        means.append(sum(drawn) / len(drawn))
    return np.quantile(means, [0.025, 0.975])


def test_intervals_of_comparisons_equal_plain_resampling(spark):
    got = {r.comparison: r for r in study.comparison_intervals(spark, SF).collect()}
    cells = {(r.model, r.subject, r.trial, r.task): r.auroc for r in A.cells(spark, SF).collect()}
    assert len(got) == 1 + 7 + 3 and {f"fig_A_N_{t}" for t in range(1, 8)} | {"A-N", "D4_A", "D4_N", "D4_R"} == set(got)
    for task in ("1", "6"):
        rows = [(s, t, x - cells["N", s, t, k]) for (m, s, t, k), x in cells.items() if m == "A" and k == task and ("N", s, t, k) in cells]
        lo, hi = brute_interval(f"fig_A_N_{task}", rows)
        r = got[f"fig_A_N_{task}"]
        assert r.n_sessions == len(rows) and abs(r.ci_lo - lo) < 1e-9 and abs(r.ci_hi - hi) < 1e-9 and abs(r["mean"] - np.mean([x[2] for x in rows])) < 1e-9


def test_a_word_without_pitch_is_an_error(spark):
    names = [*timescale.DIRECT.values(), "is_onset", "face_num", "idx_in_sentence", "bin_head"]
    words = spark.createDataFrame([(1, 1, i, "x", i / 3, i / 3 + 0.1, "VERB") for i in range(3)], "subject int, trial int, est_idx int, sentence string, start double, end double, pos string").withColumns({c: F.lit(1.0) for c in names})
    pitch = spark.createDataFrame([("0.00000", 5.0), ("0.33333", None), ("0.66667", 7.0)], "key string, pitch double")
    rows = timescale.word_variables(words, pitch).where("task = 'pitch'").orderBy("est_idx").collect()
    assert [r.value for r in rows] == [5.0, None, 7.0]
    with pytest.raises(FAILS, match="no pitch for .*0.66667"):
        timescale.word_variables(words, pitch.where("pitch is null or pitch < 6")).collect()


def test_scales_of_a_column(spark):
    lengths = [64, 100, 200, 256, 999, 1024, 2048, 5000]
    got = spark.createDataFrame([(n,) for n in lengths], "n int").select("n", columns.scales_of("n").alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: columns.geometric_scales(n) for n in lengths}
