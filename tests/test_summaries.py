from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidefold.operators import summaries


def test_merged_days_are_within_the_stated_bounds(spark, tmp_path):
    """A hot key, one of two values, one of NaN and nulls; days come in two runs that overlap."""
    rng = np.random.default_rng(0)
    rows = [("hot", int(i % 5), float(v), f"u{i % 4000}") for i, v in enumerate(rng.lognormal(size=40_000))]
    rows += [("two", i % 3, float(i % 2), "one") for i in range(999)] + [("odd", 1, None, None), ("odd", 2, float("nan"), None)]
    df = spark.createDataFrame(rows, "k string, day int, v double, u string").repartition(7)
    path = f"{tmp_path}/days"
    summaries.add_days(df.where("day < 3"), path, ["k"], "day", "v", "u")
    summaries.add_days(df.where("day > 1"), path, ["k"], "day", "v", "u")
    assert spark.read.parquet(path).count() == 5 + 3 + 2
    got = {r.k: r for r in summaries.estimates(summaries.over_days(df, path, ["k"], "day"), ["k"], {"median": 0.5, "p95": 0.95}).collect()}
    hot = np.sort([r[2] for r in rows if r[0] == "hot"])
    for name, p in (("median", 0.5), ("p95", 0.95)):
        assert abs(np.searchsorted(hot, got["hot"][name]) / len(hot) - p) < 2 * summaries.RANK_ERROR
    assert got["hot"].n == 40_000 and abs(got["hot"].n_distinct / 4000 - 1) < summaries.DISTINCT_ERROR
    assert (got["two"].n, got["two"].n_distinct, got["two"].p95) == (999, 1, 1.0)
    assert tuple(got["odd"]) == ("odd", 2, 0, 0, None, None)


def test_few_values_are_exact_and_empty_tables_stay_empty(spark):
    df = spark.range(101).selectExpr("id % 1 as k", "double(id) as v", "id")
    made = summaries.estimates(summaries.summarise(df, ["k"], "v", "id"), ["k"], {"m": 0.5}).first()
    assert (made.n, made.n_value, made.n_distinct, made.m) == (101, 101, 101, 50.0)
    assert summaries.merged(summaries.summarise(df.limit(0), ["k"], "v", "id"), ["k"]).count() == 0
    assert summaries.estimates(summaries.merged(summaries.summarise(df.withColumn("v", F.lit(None).cast("double")), ["k"], "v", "id"), ["k"]), ["k"], {"m": 0.5}).first().m is None
