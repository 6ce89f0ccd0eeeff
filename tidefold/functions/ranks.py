"""Ranks, numbers and exact quantiles of keys of any size: by cuts that a sketch or a sample finds, never by sorting a key in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import stored

#: Ranks of the quantile sketch are off by less than a 1 / ACCURACY of a key's values; brackets are twice as wide.
ACCURACY = 10_000


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows written in ranges of (keys, order), their number as _range: even ones, by a sample of the rows themselves.

    So outliers, NaN and rows that share a value don't fill a range, as long as some column of the order tells them apart.
    """
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    return stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")


def _before(rows: DataFrame, keys: Sequence[str], count: Column) -> DataFrame:
    """keys, _range and _before: what the ranges before hold. One row a key and range."""
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*keys, "_range").agg(count.alias("_in")).select(*keys, "_range", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with their number, from 0, within keys in the order of some columns; nulls come first. Rows of a null key are left out.

    Rows are written once, in ranges; each range is sorted apart, and counts are carried over from the ones before.
    """
    keys = list(keys)
    placed = ranged(rows.dropna(subset=keys) if keys else rows.withColumn("_all", F.lit(1)), keys, order)
    keys = keys or ["_all"]
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1
    found = placed.withColumn("_inside", inside).join(_before(placed, keys, F.count("*")), [*keys, "_range"])
    return found.select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("int").alias(name))


def running(rows: DataFrame, keys: Sequence[str], order: str, count: str, name: str) -> DataFrame:
    """Rows with the sum of `count` over the rows of their key that come before them; no two rows of a key share the order."""
    placed = ranged(rows, keys, [order])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("_inside", F.coalesce(F.sum(count).over(inside), F.lit(0))).join(_before(placed, keys, F.sum(count)), [*keys, "_range"])
    return found.select(*rows.columns, (F.col("_before") + F.col("_inside")).alias(name))


def lagged(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Rows with columns of the row before them in their key, by new names: null for a key's first. A null key is a key too.

    Rows are written once, in ranges. A range starts with a copy of the last row of the key's range before it, which goes again.
    """
    keys = list(keys)
    placed = ranged(rows, keys, order)
    carried = [*order, *[c for c in columns.values() if c not in order]]
    by_key = Window.partitionBy(*keys).orderBy("_range")
    ends = placed.groupBy(*keys, "_range").agg(F.max_by(F.struct(*carried), F.struct(*order)).alias("_end"))
    # equal rows share a range, so what ends one is before all of the next
    ends = ends.withColumn("_range", F.lead("_range").over(by_key)).where("_range is not null").select(*keys, "_range", "_end.*", F.lit(True).alias("_copy"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order], F.col("_copy").desc_nulls_last())
    both = placed.unionByName(ends, allowMissingColumns=True)
    return both.select("*", *[F.lag(c).over(inside).alias(name) for name, c in columns.items()]).where("_copy is null").drop("_range", "_copy")


def quantiles(rows: DataFrame, keys: Sequence[str], value: Column, at: Mapping[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and exact quantiles, interpolated between neighbours, by name; null where a key has no value.

    A mergeable sketch brackets each quantile first. A second look at the rows counts those below a bracket, and in it counts
    each value, so just some ten-thousandths of a key's distinct values are sorted. NaN and null values don't count; rows of a
    null key are left out.
    """
    keys = list(keys)
    all_keys = keys or ["_all"]
    v = value.cast("double")
    known = rows.select(*([F.lit(1).alias("_all")] if not keys else keys), F.when(~F.isnan(v), v).alias("_v")).dropna(subset=all_keys)
    wide = 2.0 / accuracy
    ends = [x for p in at.values() for x in (max(0.0, p - wide), min(1.0, p + wide))]
    bounds = known.groupBy(*all_keys).agg(F.percentile_approx("_v", ends, accuracy).alias("_ends"), F.count("_v").alias("_n"))
    bounds = stored(bounds, "brackets")
    lo, hi = [F.get("_ends", F.lit(2 * j)) for j in range(len(at))], [F.get("_ends", F.lit(2 * j + 1)) for j in range(len(at))]
    inside = [(F.col("_v") >= a) & (F.col("_v") <= b) for a, b in zip(lo, hi, strict=True)]
    within = inside[0]
    for i in inside[1:]:
        within = within | i
    below = [F.count_if(F.col("_v") < a).alias(f"_below{j}") for j, a in enumerate(lo)]
    # few values: a sketch of them is exact, but its places may be one off those of an interpolated quantile
    after = [F.min(F.when(F.col("_v") > b, F.col("_v"))).alias(f"_after{j}") for j, b in enumerate(hi)]
    after += [F.max(F.when(F.col("_v") < a, F.col("_v"))).alias(f"_ahead{j}") for j, a in enumerate(lo)]
    counts = known.join(bounds, all_keys).groupBy(*all_keys, F.when(within, F.col("_v")).alias("_w")).agg(F.count("_v").alias("_c"), F.first("_ends").alias("_ends"), F.first("_n").alias("_n"), *below, *after)
    # the rest of a key is one row; what it has below a bracket, and next to it, goes to each value
    every, upto = Window.partitionBy(*all_keys), Window.partitionBy(*all_keys).orderBy(F.col("_w").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    sums = []
    for j, (name, p) in enumerate(at.items()):
        own = F.when((F.col("_w") >= lo[j]) & (F.col("_w") <= hi[j]), F.col("_c")).otherwise(0)
        counts = counts.withColumn(f"_end{j}", F.sum(F.col(f"_below{j}")).over(every) + F.sum(own).over(upto)).withColumn(f"_own{j}", own)
        place = (F.col("_n") - 1) * F.lit(float(p))
        holds = lambda k, j=j: (F.col(f"_own{j}") > 0) & (F.col(f"_end{j}") - F.col(f"_own{j}") <= k) & (k < F.col(f"_end{j}"))
        next_ = F.coalesce(F.min(F.when(holds(F.ceil(place)), F.col("_w"))), F.min(f"_after{j}"))
        first = F.coalesce(F.min(F.when(holds(F.floor(place)), F.col("_w"))), F.max(f"_ahead{j}"))
        sums += [first.alias(f"_a_{name}"), next_.alias(f"_b_{name}"), F.max(place - F.floor(place)).alias(f"_p_{name}")]
    got = counts.groupBy(*all_keys).agg(*sums)
    between = lambda n: F.when(F.col(f"_p_{n}") > 0, F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_p_{n}")).otherwise(F.col(f"_a_{n}"))
    return got.select(*keys, *[between(n).alias(n) for n in at])
