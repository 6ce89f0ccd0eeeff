"""The fold audit over an index that grows: near pairs of two streams by state in buckets of time, spans by a running aggregate.

What the streams write are small tables, and the audit's results are read off them at any time. After the last rows they
equal those of operators.fold_audit over the whole index.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import CELL, FS

#: Widths of the widest horizon in a bucket of a cell's time.
BUCKET = 24.0


def event_time(time_col: str, fs: float = FS) -> Column:
    """A window's start as a timestamp, so many seconds after 1970, rounded down to a microsecond: what watermarks are of."""
    return F.timestamp_micros(F.floor(F.col(time_col) / F.lit(float(fs)) * 1_000_000).cast("long"))


def near_pairs(tests: DataFrame, trains: DataFrame, widest: float, late: str = "1 hour", fs: float = FS, time_col: str = "window_from", item: str = "base_index", cell: Sequence[str] = CELL, bucket: float = BUCKET) -> DataFrame:
    """cell, item, time and near_s of test rows with a train row of their cell that starts under `widest` seconds away:
    the distance of the nearest one so far, again whenever a nearer one has come.

    tests and trains are streams of the index's rows of these roles. A cell's time is cut into buckets of `bucket` times
    `widest` seconds; train rows near an edge go to the bucket beyond it too. State is a row a bucket: its sorted train
    starts, and its test rows with their nearest. New rows are looked up by bisection, so neither work nor rows
    written grow with the number of pairs. `late` bounds how far behind the newest row of its stream a row may come;
    later ones are dropped, and so are buckets that no row may come for.
    """
    cell, width = list(cell), float(bucket * widest)
    # items go as text, which train rows have empty: where a column of numbers held nulls, pandas was given wrong ones
    time_type, item_type = (tests.schema[c].dataType.simpleString() for c in (time_col, item))

    def side(rows: DataFrame, tested: bool) -> DataFrame:
        at = F.col(time_col) / F.lit(float(fs))
        of = lambda s: F.floor(s / F.lit(width)).cast("long")
        buckets = F.array(of(at)) if tested else F.sequence(of(at - F.lit(float(widest))), of(at + F.lit(float(widest))))
        kept = rows.dropna(subset=[*cell, time_col]).withColumn("_at", event_time(time_col, fs)).withWatermark("_at", late)
        return kept.select(*cell, F.explode(buckets).alias("_bucket"), F.col(time_col).alias("_t"), (F.col(item).cast("string") if tested else F.lit("")).alias("_item"), F.lit(tested).alias("_tested"), "_at")

    def nearest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts, at, items, near = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        for rows in batches:
            tested = rows["_tested"].to_numpy(bool)
            starts += rows["_t"][~tested].tolist()
            at += rows["_t"][tested].tolist()
            items += rows["_item"][tested].tolist()
        starts, t = np.unique(np.asarray(starts)), np.asarray(at)
        near = np.append(near, np.full(len(t) - len(near), np.inf))
        now = near
        if len(starts) and len(t):
            right = np.searchsorted(starts, t)
            sides = (starts[np.maximum(right - 1, 0)], starts[np.minimum(right, len(starts) - 1)])
            now = np.minimum(near, np.minimum(*(np.abs(t / fs - s / fs) for s in sides)))
        state.update((starts.tolist(), at, items, now.tolist()))
        # no row comes for a bucket once the watermark is past it and what its neighbours send
        state.setTimeoutTimestamp(max(int(((key[-1] + 1) * width + widest) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        new = np.flatnonzero((now < near) & (now < widest))
        if len(new):
            yield pd.DataFrame({k: [v] * len(new) for k, v in zip(cell, key, strict=False)} | {item: [items[i] for i in new], time_col: t[new], "near_s": now[new]})

    kinds = ", ".join(f"`{c}` {tests.schema[c].dataType.simpleString()}" for c in cell)
    both = side(tests, True).unionByName(side(trains, False)).groupBy(*cell, "_bucket")
    found = both.applyInPandasWithState(
        nearest, f"{kinds}, `{item}` string, `{time_col}` {time_type}, near_s double",
        f"starts array<{time_type}>, at array<{time_type}>, items array<string>, near array<double>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.withColumn(item, F.col(item).cast(item_type))


def follow(rows: DataFrame, path: str, checkpoint: str, partition: Sequence[str] = ()) -> StreamingQuery:
    """Appends a stream's rows to Parquet files as far as they are there now, then stops: each run goes on where the last one ended."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition).trigger(availableNow=True).start()


def adjacency(spark: SparkSession, pairs: str, index: DataFrame, within_seconds: Sequence[float] = (1.0, 5.0, 30.0), item: str = "base_index", cell: Sequence[str] = CELL) -> DataFrame:
    """Per cell: share of the index's test rows so far with a train row under each horizon away, from the pairs that near_pairs() found."""
    cell = list(cell)
    nearest = spark.read.parquet(pairs).groupBy(*cell, item).agg(F.min("near_s").alias("near_s"))
    counts = nearest.groupBy(*cell).agg(*[F.count_if(F.col("near_s") < w).alias(f"_w{k}") for k, w in enumerate(within_seconds)])
    sizes = index.groupBy(*cell).agg(F.count_if(F.col("role") == "test").alias("_n"), F.count_if(F.col("role") == "train").alias("_m")).where("_n > 0 and _m > 0")
    shares = [(F.coalesce(F.col(f"_w{k}"), F.lit(0)) / F.col("_n")).alias(f"within_{w:g}s") for k, w in enumerate(within_seconds)]
    return sizes.join(counts, cell, "left").select(*cell, *shares)


def spans(rows: DataFrame, time_col: str = "window_from", cell: Sequence[str] = CELL) -> DataFrame:
    """Running ends of each class's test rows by cell: cell, label, lo, hi and n. State is a row a cell and label."""
    return rows.where(F.col("role") == "test").groupBy(*cell, "label").agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"), F.count("*").alias("n"))
