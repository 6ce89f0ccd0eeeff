"""How far a benchmark's folds let time leak into labels, from its index alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..functions.ranks import numbered, quantiles
from ..model import CELL, DATASET, FS
from ..sources.writers import stored


def scored(index: DataFrame) -> DataFrame:
    return index.where(F.col("role") == "test")


def _keyed(index: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Rows whose whole key is there; the others belong to no cell."""
    return index.dropna(subset=list(cell))


def _guard(bad: Column, cell: Sequence[str], what: str) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit("cell "), F.to_json(F.struct(*cell)), F.lit(f": {what}"))))


def single_class_share(index: DataFrame, time_col: str = "window_from", cell: Sequence[str] = CELL, missing: str = "error") -> DataFrame:
    """Per cell: share of test rows outside the span of time that both classes occupy, bounds inside.

    Labels other than 0 and 1 set no bounds but count. Where the classes don't overlap in time the share is 1. A cell
    that lacks a class raises an error, or is left out (missing="drop"). Two aggregations with map-side sums; rows are
    never gathered by cell, so a cell of any size costs a scan.
    """
    cell, t = list(cell), F.col(time_col)
    rows = scored(_keyed(index, cell)).select(*cell, t.alias("_t"), "label")
    of = lambda f, label: f(F.when(F.col("label") == label, F.col("_t")))
    bounds = rows.groupBy(cell).agg(of(F.min, 0).alias("a0"), of(F.max, 0).alias("b0"), of(F.min, 1).alias("a1"), of(F.max, 1).alias("b1"))
    lacks = F.col("a0").isNull() | F.col("a1").isNull()
    if missing == "drop":
        bounds = bounds.where(~lacks)
    bounds = bounds.select(*cell, F.greatest("a0", "a1").alias("_lo"), F.least("b0", "b1").alias("_hi"), (_guard(lacks, cell, "scored set lacks a class") if missing != "drop" else F.lit(None).cast("string")).alias("_bad"))
    outside = F.when(F.col("_bad").isNull() & (F.col("_t") >= F.col("_lo")) & (F.col("_t") <= F.col("_hi")), 0.0).otherwise(1.0)
    return rows.join(bounds, cell).groupBy(cell).agg(F.avg(outside).alias("single_class_share"))


def nearest_train(index: DataFrame, fs: float = FS, time_col: str = "window_from", cell: Sequence[str] = CELL, bucket_seconds: float = 3600.0) -> DataFrame:
    """Every test row's key and its distance in seconds to the nearest train row of its cell: a two-sided as-of join.

    A cell's time is cut into buckets. Rows are sorted within a bucket; what lies beyond it is the last train start of
    the buckets before and the first of those behind, carried over a table of one row a bucket. So a cell of any size
    is sorted in many tasks. Distance is null where a cell has no train row.
    """
    cell = list(cell)
    rows = _keyed(index, cell).where(F.col("role").isin("test", "train")).select(*cell, F.col(time_col).alias("_t"), (F.col("role") == "train").alias("_train"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_t") / F.lit(float(fs * bucket_seconds))))
    train_t = F.when(F.col("_train"), F.col("_t"))
    ends = rows.groupBy(*cell, "_bucket").agg(F.min(train_t).alias("first"), F.max(train_t).alias("last"))
    by_cell = Window.partitionBy(*cell).orderBy("_bucket")
    ends = ends.select(
        *cell, "_bucket",
        F.max("last").over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
        F.min("first").over(by_cell.rowsBetween(1, Window.unboundedFollowing)).alias("_right"),
    )
    inside = Window.partitionBy(*cell, "_bucket").orderBy("_t")
    before = F.max(train_t).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(train_t).over(inside.rangeBetween(0, Window.unboundedFollowing))
    near = rows.withColumn("_before", before).withColumn("_after", after).where(~F.col("_train")).join(ends, [*cell, "_bucket"])
    here = seconds("_t", fs)
    far = lambda c: F.abs(here - seconds(c, fs))
    return near.select(*cell, F.col("_t").alias(time_col), F.least(*[far(c) for c in ("_before", "_after", "_left", "_right")]).alias("near_s"))


def train_test_adjacency(
    index: DataFrame, within_seconds: Sequence[float] = (1.0, 5.0, 30.0), fs: float = FS, time_col: str = "window_from", cell: Sequence[str] = CELL, bucket_seconds: float = 3600.0
) -> DataFrame:
    """Per cell: share of test rows with a train row starting less than each horizon away, as within_{w}s.

    A cell without train or test rows raises an error.
    """
    cell = list(cell)
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    sizes = _keyed(index, cell).groupBy(cell).agg(count("train").alias("n_train"), count("test").alias("n_test"))
    shares = nearest_train(index, fs, time_col, cell, bucket_seconds).groupBy(cell).agg(*[F.avg((F.col("near_s") < w).cast("double")).alias(f"within_{w:g}s") for w in within_seconds])
    guard = _guard((F.col("n_train") == 0) | (F.col("n_test") == 0), cell, "empty train or test")
    checked = sizes.join(shares, cell, "left").withColumn("_bad", guard).where("_bad is null")
    return checked.select(*cell, *[f"within_{w:g}s" for w in within_seconds])


def median_cut(rows: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Rows with the exact interpolated median of a column within their keys; a sketch brackets it first.

    The medians, one row a key, are written first, so the rows' plan isn't repeated in what follows.
    """
    return rows.join(stored(quantiles(rows, keys, F.col(column), {name: 0.5}), "medians"), list(keys))


def common_time_folds(items: DataFrame, time_col: str = "window_from", id_col: str = "base_index", dataset: Sequence[str] = DATASET) -> DataFrame:
    """Two folds cut at one median time shared by all classes of a dataset.

    Rows before the cut are the part held out by fold 0, the others that of fold 1. The held part is cut at its own
    median: before it val, from it on test; the other part trains. Rows come with fold, role and item, their number in
    (time, id) order within fold and role. With many ties val may be empty; a part without rows gives none.
    """
    keys = list(dataset)
    cut = median_cut(_keyed(items, keys), keys, time_col, "_cut").withColumn("_part", (F.col(time_col) >= F.col("_cut")).cast("int"))
    parts = median_cut(cut, [*keys, "_part"], time_col, "_held_cut")
    held = F.when(F.col(time_col) < F.col("_held_cut"), "val").otherwise("test")
    sides = F.array(F.struct(F.col("_part").alias("fold"), held.alias("role")), F.struct((1 - F.col("_part")).alias("fold"), F.lit("train").alias("role")))
    both = parts.select(*items.columns, F.explode(sides).alias("_side")).select(*items.columns, "_side.fold", "_side.role")
    return number_items(both, time_col, id_col, [*keys, "fold", "role"])


def number_items(rows: DataFrame, time_col: str, id_col: str, keys: Sequence[str]) -> DataFrame:
    return numbered(rows, keys, (time_col, id_col), "item")


def single_source(index: DataFrame, cell: Sequence[str] = CELL, source: Sequence[str] = ("src_subject", "src_trial")) -> DataFrame:
    """cell, role and source of the train and test rows of each cell; a cell whose role has several sources raises an error."""
    rows = _keyed(index, cell).where(F.col("role").isin("train", "test"))
    ends = rows.groupBy(*cell, "role").agg(F.min(F.struct(*source)).alias("_a"), F.max(F.struct(*source)).alias("_b"))
    one = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("_a")).otherwise(F.raise_error(F.concat(F.lit("cell "), F.to_json(F.struct(*cell, "role")), F.lit(": several source sessions"))))
    return ends.withColumn("_a", one).select(*cell, "role", *[F.col(f"_a.{c}").alias(c) for c in source])


def fold_quality(index: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Per cell: rows to test and train on, and how many labels the test rows have."""
    cell = list(cell)
    role = lambda r, c=F.lit(1): F.when(F.col("role") == r, c)
    return _keyed(index, cell).groupBy(cell).agg(F.count(role("test")).alias("n_test"), F.count(role("train")).alias("n_train"), F.countDistinct(role("test", F.col("label"))).alias("n_labels"))


def check_folds(index: DataFrame, window: int, cell: Sequence[str] = CELL) -> DataFrame:
    """The index itself; reading it fails if a window isn't `window` samples wide. Width is checked row by row."""
    wrong = F.col("window_to") - F.col("window_from") != window
    return index.withColumn("window_to", F.when(wrong, F.raise_error(F.lit(f"a window is not {window} samples wide"))).otherwise(F.col("window_to")))


def role_counts(index: DataFrame, by: Sequence[str] = ("role",), session: Sequence[str] = ("test_subject", "test_trial")) -> DataFrame:
    """Rows and distinct windows by role (or by split and role)."""
    return index.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct(*session, "window_from").alias("distinct_windows"))


def distinct_windows(index: DataFrame, session: Sequence[str] = ("test_subject", "test_trial")) -> DataFrame:
    """Sorted distinct window starts of each session, to extract each once however many folds share it."""
    return index.select(*session, "window_from").distinct().orderBy(*session, "window_from")


def unique_window_totals(index: DataFrame, session: Sequence[str] = ("test_subject", "test_trial")) -> DataFrame:
    """Distinct windows of each session, and of all in a row of null keys."""
    one = index.select(*session, "window_from").distinct()
    return one.rollup(F.struct(*session).alias("_s")).count().select(*[F.col(f"_s.{c}") for c in session], F.col("count").alias("windows"))
