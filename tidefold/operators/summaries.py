"""Summaries that add up: sketches of a column's values and of its distinct ones, stored by key and day, merged when asked for.

A day's rows are read once. Sketches of any set of days are merged without them: a few kilobytes each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import append_new, read_appended

#: Size of a quantile sketch: ranks are off by less than RANK_ERROR of all values, in 99 of 100 sketches.
QUANTILE_K, RANK_ERROR = 800, 0.0035
#: Log2 of a distinct sketch's buckets: counts are off by some 1.04 / sqrt(2^HLL_K), and in 99 of 100 by less than this share.
HLL_K, DISTINCT_ERROR = 14, 0.025


def summarise(rows: DataFrame, keys: Sequence[str], value: str, item: str) -> DataFrame:
    """keys, n (rows), n_value (values that count), quantiles and distinct (sketches of `value` and of `item`).

    NaN and null values don't count, nor do null items; a key of such alone has null sketches. Sketches are made in each task and
    merged, so a key of any size sends one a task.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    known = rows.select(*keys, v.alias("_v"), F.col(item).cast("string").alias("_i"))
    sums = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("_v").alias("n_value"), F.kll_sketch_agg_double("_v", F.lit(QUANTILE_K)).alias("quantiles"),
        F.hll_sketch_agg("_i", F.lit(HLL_K)).alias("distinct"), F.count("_i").alias("_items"),
    )
    return sums.select(*keys, "n", "n_value", F.when(F.col("n_value") > 0, F.col("quantiles")).alias("quantiles"), F.when(F.col("_items") > 0, F.col("distinct")).alias("distinct"))


def merged(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries by fewer keys."""
    sums = summaries.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_value").alias("n_value"), F.kll_merge_agg_double("quantiles", F.lit(QUANTILE_K)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"), F.count("distinct").alias("_some"),
    )
    return sums.select(*keys, "n", "n_value", F.when(F.col("n_value") > 0, F.col("quantiles")).alias("quantiles"), F.when(F.col("_some") > 0, F.col("distinct")).alias("distinct"))


def estimates(summaries: DataFrame, keys: Sequence[str], at: Mapping[str, float]) -> DataFrame:
    """keys, n, n_value, n_distinct and quantiles by name; null where a key has no value, 0 where it has no item."""
    quantile = lambda p: F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))))
    return summaries.select(*keys, "n", "n_value", F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).cast("long").alias("n_distinct"), *[quantile(p).alias(name) for name, p in at.items()])


def add_days(rows: DataFrame, path: str, keys: Sequence[str], day: str, value: str, item: str) -> None:
    """Stores the summaries of the days that rows has and the store hasn't: a day comes whole, once."""
    append_new(summarise(rows, [*keys, day], value, item), path, [*keys, day])


def over_days(rows: DataFrame, path: str, keys: Sequence[str], day: str) -> DataFrame:
    """Merged summaries of all stored days by keys; `rows` tells the session."""
    return merged(read_appended(rows.sparkSession, path, [*keys, day]), keys)
