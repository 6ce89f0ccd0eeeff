from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidefold.operators import fold_audit
from tidefold.plans import adapters as A
from tidefold.streaming import growing

CELL = ["test_subject", "test_trial", "task", "fold"]


@pytest.mark.parametrize("parts", [1, 3])
def test_growing_index_equals_batch(spark, tmp_path, parts):
    """Rows come by time in several runs; each run goes on where the one before stopped."""
    index = A.fold_index(spark, "/root/testdata/sf0.001").where("test_subject < 3")
    source, state = f"{tmp_path}/index", {n: f"{tmp_path}/{n}" for n in ("pairs", "c1", "c2")}
    edges = [0, *index.selectExpr(f"percentile(window_from, array({', '.join(str((k + 1) / parts) for k in range(parts))})) as p").first().p]
    edges[-1] += 1
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        index.where(f"window_from >= {lo} and window_from < {hi}").write.mode("append").parquet(source)
        rows = spark.readStream.schema(index.schema).parquet(source)
        pairs = growing.near_pairs(rows.where("role = 'test'"), rows.where("role = 'train'"), 3600.0, "2 days")
        growing.follow(pairs, state["pairs"], state["c1"]).awaitTermination()
        ends = growing.spans(rows).writeStream.format("memory").queryName(f"ends{parts}").outputMode("complete").option("checkpointLocation", state["c2"]).trigger(availableNow=True).start()
        ends.awaitTermination()
    within = (60.0, 600.0, 3600.0)
    got = {tuple(r[:4]): tuple(r[4:]) for r in growing.adjacency(spark, state["pairs"], index, within).collect()}
    want = {tuple(r[:4]): tuple(r[4:]) for r in fold_audit.train_test_adjacency(index, within).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(a == pytest.approx(b, abs=1e-12) for k in got for a, b in zip(got[k], want[k], strict=True))
    spans = {tuple(r[:5]): tuple(r[5:]) for r in spark.table(f"ends{parts}").select(*CELL, "label", "lo", "hi", "n").collect()}
    batch = {tuple(r[:5]): tuple(r[5:]) for r in growing.spans(index).select(*CELL, "label", "lo", "hi", "n").collect()}
    assert spans == batch and sum(n for *_, n in spans.values()) == index.where("role = 'test'").count()


def test_near_pairs_are_one_a_test_row_however_many_trains_are_near(spark, tmp_path):
    """Train rows of a cell that are all near each test row: rows written follow the test rows, not the pairs."""
    schema = "test_subject int, test_trial int, task string, fold int, role string, base_index string, window_from long"
    rows = [(k % 2, 0, "a", 0, role, f"{role}{k}", 2048 * (90 + (k * 37) % 400) + k % 5) for k in range(400) for role in ("test", "train")]
    for part in (rows[:300], rows[300:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/index")
        read = spark.readStream.schema(schema).parquet(f"{tmp_path}/index")
        growing.follow(growing.near_pairs(read.where("role = 'test'"), read.where("role = 'train'"), 100.0, "2 days", bucket=1.5), f"{tmp_path}/pairs", f"{tmp_path}/state").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() <= 2 * 400
    starts = [[r[6] / 2048 for r in rows if r[0] == s and r[4] == "train"] for s in (0, 1)]
    want = {r[5]: min(abs(r[6] / 2048 - t) for t in starts[r[0]]) for r in rows if r[4] == "test"}
    assert {r.base_index: r.near for r in found.groupBy("base_index").agg(F.min("near_s").alias("near")).collect()} == want
