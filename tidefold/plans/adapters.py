"""The driver's tables in the shape of the audit's: realistic shapes, without their meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import FS
from ..sources import writers

#: Start of the events, in microseconds.
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfolded items: session, task, base_index, window_from, label, value."""
    e = table(spark, sf_dir, "events")
    start = F.floor((micros() - EPOCH_US) * F.lit(int(FS)) / 1000000.0).cast("long")
    return e.select(
        (F.col("user_id") % 6).cast("int").alias("test_subject"), (F.floor(F.col("user_id") / 6) % 2).cast("int").alias("test_trial"), F.col("event_type").alias("task"),
        F.col("event_id").alias("base_index"), start.alias("window_from"), (F.col("value") >= 35).cast("int").alias("label"), "value",
    )


def fold_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds cut in time per class: the held half of each label is cut into validation and test."""
    items = events(spark, sf_dir).drop("value")
    group = ["test_subject", "test_trial", "task", "label"]
    order = ["window_from", "base_index"]
    halves = items.withColumn("_h", F.ntile(2).over(Window.partitionBy(*group).orderBy(*order)) - 1)
    quarters = halves.withColumn("_q", F.ntile(2).over(Window.partitionBy(*group, "_h").orderBy(*order)))
    held = F.struct(F.col("_h").alias("fold"), F.when(F.col("_q") == 1, "val").otherwise("test").alias("role"))
    other = F.struct((1 - F.col("_h")).alias("fold"), F.lit("train").alias("role"))
    both = quarters.withColumn("_s", F.explode(F.array(held, other)))
    return both.select("test_subject", "test_trial", "task", F.col("_s.fold").cast("int").alias("fold"), "_s.role", "base_index", "window_from", "label")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as the table that it is to an audit: several branches of a plan read it, and none makes it again."""
    path = writers.scratch(spark, "index")
    fold_index(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, subject, trial, task, auroc from order lines: 3 models, 12 sessions, 7 tasks."""
    rows = decoded(spark, sf_dir)
    return rows.groupBy(F.col("rung").alias("model"), F.col("test_subject").alias("subject"), F.col("test_trial").alias("trial"), "task").agg(F.avg("test_auroc").alias("auroc"))


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single results: rung, split, test_subject, test_trial, task, fold, test_auroc."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_returnflag").alias("rung"), F.lit("within").alias("split"), (F.col("l_suppkey") % 6).cast("int").alias("test_subject"), (F.floor(F.col("l_suppkey") / 6) % 2).cast("int").alias("test_trial"),
        F.col("l_linenumber").cast("string").alias("task"), (F.col("l_orderkey") % 2).cast("int").alias("fold"), (F.col("l_discount") * 10).alias("test_auroc"),
    )


def electrodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """electrode, mean_auroc from parts: named by type, brand number and size, in runs of 2 to 5 numbers."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    name = F.concat("p_type", (brand * 4 + F.least(F.col("p_size") % 5, brand % 4)).cast("string"))
    return p.groupBy(name.alias("electrode")).agg(F.avg("p_retailprice").alias("mean_auroc"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, samples (64 doubles), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("samples"), "label")
