from __future__ import annotations

import gzip
import hashlib
import json
import threading

import numpy as np
import pytest
from conftest import FAILS
from pyspark.sql import functions as F

from tidefold.operators import fluctuation, inference
from tidefold.sources import readers, synthetic, writers


def test_decoded_files_of_different_columns(spark, tmp_path):
    head = "split,test_subject,test_trial,task,fold,rung,n_train,n_test,n_features,test_auroc,train_auroc"
    (tmp_path / "L1.csv").write_text(f"{head},n_excluded_plateau\nwithin,1,1,onset,0,L1,10,5,3,0.5,0.75,2\n")
    (tmp_path / "x").mkdir()
    (tmp_path / "x/L0.csv").write_text(f"{head}\nwithin,1,1,onset,0,L0,10,5,3,0.25,0.75\nwithin,1,1,onset,1,L0,10,5,3,0.75,0.75\n")
    a, b = readers.read_decoded(spark, str(tmp_path)), readers.read_decoded(spark, f"{tmp_path}/x")
    assert a.schema == b.schema and a.first().n_excluded_plateau == 2 and b.first().n_excluded_plateau is None
    assert readers.read_decoded(spark, f"{tmp_path}/none").count() == 0
    assert [r.auroc for r in inference.cell_means(b).collect()] == [0.5]


def test_index_is_pruned(spark, tmp_path):
    with gzip.open(tmp_path / "i.csv.gz", "wt") as f:
        f.write("split,test_subject,test_trial,task,fold,role,src_subject,src_trial,item,base_index,window_from,window_to,label\nwithin,1,2,onset,0,test,1,2,0,7,100,2148,1\n")
    index = readers.read_index(spark, f"{tmp_path}/i.csv.gz", ["window_from", "role"])
    assert [tuple(r) for r in index.collect()] == [(100, "test")]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<role:string,window_from:bigint>" in plan


def test_nested_results(spark, tmp_path):
    folds = lambda *xs: {"population": {"one_second_after_onset": {"folds": [{"test_roc_auc": x} for x in xs]}}}
    (tmp_path / "population_onset.json").write_text(json.dumps({"evaluation_results": {"btbank1_2": folds(0.5, 0.75), "btbank10_0": folds(1.0)}}, indent=1))
    got = readers.read_leaderboard(spark, f"{tmp_path}/*.json", "m", "within").orderBy("subject").collect()
    assert [tuple(r) for r in got] == [("m", "within", 1, 2, "onset", 0.625), ("m", "within", 10, 0, "onset", 1.0)]


def test_side_tables(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"s1_t2": ["B1", "A2"]}))
    assert [tuple(r) for r in readers.read_subsets(spark, f"{tmp_path}/s.json").collect()] == [(1, 2, 1, "B1"), (1, 2, 2, "A2")]
    (tmp_path / "p.json").write_text(json.dumps({"1.5": {"enhanced_pitch": 3.0, "x": 1}, "2.000001": {"enhanced_pitch": None}}))
    assert sorted(tuple(r) for r in readers.read_keyed_numbers(spark, f"{tmp_path}/p.json", "enhanced_pitch").collect()) == [("1.50000", 3.0), ("2.00000", None)]
    lines = [{"name": "a", "bytes": 1, "downloaded_utc": "2026-01-01"}, {"name": "a", "bytes": 2, "downloaded_utc": "2026-01-02"}, {"name": "b", "bytes": 3}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert sorted((r.name, r.bytes) for r in readers.read_manifest(spark, f"{tmp_path}/m.jsonl").collect()) == [("a", 2), ("b", 3)]
    digest = readers.file_digests(spark, f"{tmp_path}/s.json").first()
    assert digest.sha256 == hashlib.sha256((tmp_path / "s.json").read_bytes()).hexdigest()
    (tmp_path / "electrode_mean_s3_t0.csv").write_text("electrode,mean_auroc\nA1,0.5\n")
    assert [tuple(r) for r in readers.read_electrode_means(spark, str(tmp_path)).collect()] == [(3, 0, "A1", 0.5)]


def test_appended_once(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = lambda *ks: spark.createDataFrame([(k, k * 0.5) for k in ks], "k int, v double")
    writers.append_new(rows(1, 2), path, ["k"])
    writers.append_new(rows(2, 3, 3), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    assert sorted(map(tuple, writers.read_appended(spark, path, ["k"]).collect())) == [(1, 0.5), (2, 1.0), (3, 1.5)]
    assert [r.k for r in writers.todo(rows(3, 4), path, ["k"]).collect()] == [4]


def test_two_writers_at_once_leave_each_key_once(spark, tmp_path, monkeypatch):
    """Both have looked for what is there before either has added anything; a third fails and leaves nothing to be seen."""
    path, met, todo = f"{tmp_path}/out", threading.Barrier(2), writers.todo

    def meeting(*args):
        out = todo(*args)
        met.wait(60)
        return out

    monkeypatch.setattr(writers, "todo", meeting)
    frames = [spark.range(a, a + 60).selectExpr("id as k", f"'{name}' as by") for name, a in (("x", 0), ("y", 30))]
    threads = [threading.Thread(target=writers.append_new, args=(f, path, ["k"])) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    with pytest.raises(FAILS):
        writers.append_new(spark.range(95, 99).selectExpr("id as k", "cast(raise_error('lost') as string) as by"), path, ["k"])
    assert spark.read.parquet(path).count() == 120  # the keys of both are there twice
    got = {r.k: r.by for r in writers.read_appended(spark, path, ["k"]).collect()}
    assert sorted(got) == list(range(90)) and len({got[k] for k in range(30, 60)}) == 1 and got[0] == "x" and got[89] == "y"
    writers.append_new(spark.range(80, 95).selectExpr("id as k", "'z' as by"), path, ["k"])
    want = got | dict.fromkeys(range(90, 95), "z")
    assert {r.k: r.by for r in writers.read_appended(spark, path, ["k"]).collect()} == want
    writers.compact(spark, path, ["k"])
    assert spark.read.parquet(path).count() == 95 and {r.k: r.by for r in writers.read_appended(spark, path, ["k"]).collect()} == want


def test_documents(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "name string, n int, v double")
    writers.write_document(df, f"{tmp_path}/d", "name")
    [file] = (tmp_path / "d").glob("part-*")
    assert json.loads(file.read_text()) == {"a": {"n": 1, "v": None}, "b": {"n": 2, "v": 0.5}}
    writers.write_csv(df, f"{tmp_path}/c", "gzip")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2
    writers.write_numbers(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_noise_of_known_exponent(spark):
    x = np.concatenate([synthetic.fgn(4096, 0.8, s) for s in range(20)])
    assert abs(x.std() - 1) < 0.15 and abs(np.corrcoef(x[:-1], x[1:])[0, 1] - (2 ** (2 * 0.8 - 1) - 1)) < 0.05
    assert np.array_equal(synthetic.fgn(64, 0.3, 5), synthetic.fgn(64, 0.3, 5))
    made = fluctuation.dfa(synthetic.replicates(spark, (0.3, 0.7), (1024,), 12), [8, 11, 15, 21, 28, 39, 53, 73, 99, 128])
    for r in made.groupBy("family", "exponent").agg({"hurst": "avg", "truth": "first"}).collect():
        assert abs(r["avg(hurst)"] - r["first(truth)"]) < 0.08


def test_tasks_that_make_signals_grow_with_their_number(spark):
    """A worker holds some dozen signals, not a share of all of them."""
    made = synthetic.replicates(spark, (0.3,), (16,), 6000)
    tasks = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 12 > spark.sparkContext.defaultParallelism and max(r["count"] for r in tasks) <= 1024
    for r in made.where("rep % 1999 = 7 and family = 'fgn'").collect():
        assert r.samples == synthetic.fgn(16, 0.3, r.seed).tolist()
