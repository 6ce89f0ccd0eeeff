from __future__ import annotations

import random

import pytest
from conftest import FAILS

from tidefold.operators import fold_audit

SCHEMA = "test_subject int, test_trial int, task string, fold int, role string, label int, window_from long"


def index(spark, rows):
    return spark.createDataFrame([(1, 1, "t", 0, *r) for r in rows], SCHEMA)


def test_share_outside_the_common_span(spark):
    rows = [("test", 1, t) for t in range(10)] + [("test", 0, t) for t in range(5, 15)] + [("train", 1, 100)]
    assert fold_audit.single_class_share(index(spark, rows)).first().single_class_share == 0.5
    interleaved = [("test", 1 - t % 2, t) for t in range(20)]
    assert fold_audit.single_class_share(index(spark, interleaved)).first().single_class_share <= 0.1
    apart = [("test", 1, t) for t in range(5)] + [("test", 0, t) for t in range(9, 12)] + [("test", 2, 7)]
    assert fold_audit.single_class_share(index(spark, apart)).first().single_class_share == 1.0


def test_a_class_is_missing(spark):
    one = index(spark, [("test", 1, 5), ("train", 0, 6)])
    with pytest.raises(FAILS, match="lacks a class"):
        fold_audit.single_class_share(one).collect()
    assert fold_audit.single_class_share(one, missing="drop").count() == 0
    null_key = spark.createDataFrame([(1, 1, None, 0, "test", 1, 5)], SCHEMA)
    assert fold_audit.single_class_share(null_key).count() == 0


def test_adjacency(spark):
    rows = [("test", 1, 10 * 2048), ("test", 0, 50 * 2048), ("train", 1, int(10.5 * 2048)), ("train", 0, 200 * 2048)]
    got = fold_audit.train_test_adjacency(index(spark, rows), (1, 60)).first()
    assert (got.within_1s, got.within_60s) == (0.5, 1.0)
    with pytest.raises(FAILS, match="empty train or test"):
        fold_audit.train_test_adjacency(index(spark, rows[:2])).collect()


@pytest.mark.parametrize("bucket", [0.01, 5.0, 1e6])
def test_nearest_equals_brute_force(spark, bucket):
    rng = random.Random(1)
    rows = [(rng.choice(["test", "train", "val"]), rng.choice([0, 1]), rng.randrange(60_000)) for _ in range(300)]
    train = [t for r, _, t in rows if r == "train"]
    got = fold_audit.nearest_train(index(spark, rows), bucket_seconds=bucket).collect()
    assert sorted(got and [(r.window_from, r.near_s) for r in got]) == sorted((t, min(abs(t / 2048 - x / 2048) for x in train)) for r, _, t in rows if r == "test")


def test_common_time_folds(spark):
    rng = random.Random(0)
    times = [3000 * i for i in range(200)]
    rng.shuffle(times)
    items = spark.createDataFrame([(1, 1, "t", i, t, i % 2) for i, t in enumerate(times)], "test_subject int, test_trial int, task string, base_index long, window_from long, label int")
    rows = fold_audit.common_time_folds(items).collect()
    for fold in (0, 1):
        of = {r: [x for x in rows if x.fold == fold and x.role == r] for r in ("train", "val", "test")}
        assert sum(map(len, of.values())) == 200 == len({x.base_index for v in of.values() for x in v})
        span = {r: (min(x.window_from for x in v), max(x.window_from for x in v)) for r, v in of.items()}
        assert span["val"][1] < span["test"][0]
        assert span["train"][1] < span["val"][0] or span["test"][1] < span["train"][0]
        for v in of.values():
            assert [x.item for x in sorted(v, key=lambda x: (x.window_from, x.base_index))] == list(range(len(v)))


def test_window_width(spark):
    df = spark.createDataFrame([(0, 2048), (5, 2000)], "window_from long, window_to long")
    assert fold_audit.check_folds(df.limit(1), 2048).count() == 1
    with pytest.raises(FAILS, match="2048 samples wide"):
        fold_audit.check_folds(df, 2048).collect()
