"""Labels on a regular time grid, and how long they stay alike."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import float_key, is_finite, refuse
from ..functions.ranks import lagged
from ..model import LAG_CAP, LEAST_PAIRS

# Task variables that are a column of the word table, and its name there
DIRECT = {
    "volume": "rms", "delta_volume": "delta_rms", "frame_brightness": "mean_pixel_brightness", "global_flow": "max_global_magnitude",
    "local_flow": "max_vector_magnitude", "gpt2_surprisal": "gpt2_surprisal", "word_length": "word_length",
}


def word_variables(words: DataFrame, pitch: DataFrame | None = None, session: Sequence[str] = ("subject", "trial"), order: str = "est_idx") -> DataFrame:
    """session, start, est_idx, task, value: every task's variable of every word.

    Direct columns, five indicators, the gap to the word before in the same sentence (null for the first), presence of
    speech, and pitch from a side table (movie key, key, pitch) joined on the start time's text where it's given: a word
    without a row there is an error. Words are written once, in ranges of a session's order, so a session of any length
    is spread over tasks.
    """
    words = lagged(words, session, [order], {"_sentence": "sentence", "_end": "end"})
    same = F.col("_sentence") == F.col("sentence")
    yes = lambda c: c.cast("double")
    values = {t: F.col(c).cast("double") for t, c in DIRECT.items()}
    values |= {
        "onset": yes(F.col("is_onset") == 1), "face_num": yes(F.col("face_num").cast("int") > 0), "word_index": yes(F.col("idx_in_sentence").cast("int") == 0),
        "word_head_pos": yes(F.col("bin_head").cast("int") == 0), "word_part_speech": yes(F.col("pos") == "VERB"),
        "word_gap": F.when(same, F.col("start") - F.col("_end")), "speech": F.lit(1.0),
    }
    if pitch is not None:
        on = [*[c for c in session if c in pitch.columns], "key"]
        words = words.withColumn("key", float_key("start")).join(pitch.select(*on, F.struct("pitch").alias("_pitch")), on, "left")
        values["pitch"] = refuse(F.col("_pitch").isNull(), F.concat(F.lit("no pitch for "), F.to_json(F.struct(*on))), F.col("_pitch.pitch").cast("double"))
    wide = words.select(*session, "start", order, *[v.alias(t) for t, v in values.items()])
    return wide.unpivot([*session, "start", order], list(values), "task", "value")


def gap_in_sequence(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str | Column, end: str | Column, group: str) -> DataFrame:
    """Rows with gap: start less the end of the row before, if that is of the same group; null else."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    prior = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("gap", F.when(F.lag(group).over(prior) == F.col(group), start - F.lag(end).over(prior)))


def bin_grid(rows: DataFrame, keys: Sequence[str], time: str | Column, value: str | Column, length: int | DataFrame) -> DataFrame:
    """keys, bin, value: means by whole seconds (or hours) from 0 to length - 1, null for an empty bin.

    Rows out of range or with a value that isn't finite are left out. length is one for all, or a table (keys, length).
    """
    keys = list(keys)
    time, value = (F.col(c) if isinstance(c, str) else c for c in (time, value))
    lengths = rows.select(*keys).distinct().withColumn("length", F.lit(length)) if isinstance(length, int) else length
    bins = lengths.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1)).alias("bin"))
    means = rows.select(*keys, F.floor(time).cast("long").alias("bin"), value.cast("double").alias("_v")).where(is_finite("_v")).groupBy(*keys, "bin").agg(F.avg("_v").alias("value"))
    return bins.join(means, [*keys, "bin"], "left")


def presence(grid: DataFrame) -> DataFrame:
    """A grid with 1 where a bin has a value and 0 elsewhere."""
    return grid.withColumn("value", F.col("value").isNotNull().cast("double"))


def finite_bins(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """grid_seconds and finite_seconds by key."""
    return grid.groupBy(*keys).agg(F.count("*").alias("grid_seconds"), F.count_if(is_finite("value")).alias("finite_seconds"))


def lag_sums(x: np.ndarray, own: int, lags: int) -> np.ndarray:
    """(6, lags) for lags from 1: pairs, and the sums of x, x^2, y, y^2 and xy over them; x is at one of the first `own`
    places and y a lag later, and NaN is no value. One product of matrices for all lags at once."""
    known = np.isfinite(x)
    v = np.where(known, x, 0.0)
    powers = np.stack([known.astype(float), v, v * v])
    later = np.lib.stride_tricks.sliding_window_view(np.pad(powers, ((0, 0), (0, lags))), lags + 1, axis=1)[:, :own, 1:]
    s = np.einsum("ai,bil->abl", powers[:, :own], later, optimize=True)
    return np.stack([s[0, 0], s[1, 0], s[2, 0], s[0, 1], s[0, 2], s[1, 1]])


#: Bins of a part of a recording.
PART = 1 << 13
_SUMS = ("n", "x", "xx", "y", "yy", "xy")


def acf_timescale(grid: DataFrame, keys: Sequence[str], cap: int = LAG_CAP, least: int = LEAST_PAIRS, part: int = PART) -> DataFrame:
    """tau by key: the first lag where bins that far apart correlate under 1/e; null if too few pairs come first.

    Pairs need values on both sides; under `least` of them, or a side whose variance is under a 10^-12th of its mean
    square, give null if they come before the crossing. Without a crossing up to cap (or the grid's length - 2) tau is
    cap. A recording is cut into parts of `part` bins, each with the `cap` bins that follow it; the parts' sums, taken
    around the part's mean and then moved to one mean for all, add up. So a recording of any length is spread over tasks,
    and the grid is read once.
    """
    keys, part = list(keys), max(part, cap)
    kinds = ", ".join(f"`{k}` {grid.schema[k].dataType.simpleString()}" for k in keys)
    whole = F.expr(f"floor(bin / {part})")
    rows = grid.select(*keys, F.col("bin").cast("long").alias("bin"), F.when(is_finite("value"), F.col("value").cast("double")).alias("value"))
    both = F.when(F.col("bin") - whole * part < cap, F.array(whole, whole - 1)).otherwise(F.array(whole))
    parts = rows.withColumn("_part", F.explode(both))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        at, v = g["bin"].to_numpy(np.int64) - int(key[-1]) * part, g["value"].to_numpy(float)
        own, known = at[at < part], np.isfinite(v)
        mean = v[known].mean() if known.any() else 0.0
        x = np.full(part + cap, np.nan)
        x[at] = v - mean
        end = int(at.max()) + 1
        s = lag_sums(x[:end], min(part, end), cap)
        ends = {"mean": mean, "lo": own.min(initial=1 << 62) + int(key[-1]) * part, "hi": own.max(initial=0) + int(key[-1]) * part}
        out = pd.DataFrame({k: [v] * cap for k, v in zip(keys, key, strict=False)} | {"lag": np.arange(1, cap + 1)} | dict(zip(_SUMS, s, strict=True)) | ends)
        return out if len(own) else out[:0]  # none of what just follows a part without rows

    sums = parts.groupBy(*keys, "_part").applyInPandas(run, f"{kinds}, lag int, {', '.join(f'{c} double' for c in _SUMS)}, mean double, lo long, hi long")
    by_lag = Window.partitionBy(*keys, "lag")
    moved = F.col("mean") - F.avg("mean").over(by_lag)
    shift = {"n": F.col("n")} | {c: F.col(c) + F.col("n") * F.col("_d") for c in ("x", "y")}
    shift |= {f"{c}{c}": F.col(f"{c}{c}") + 2 * F.col("_d") * F.col(c) + F.col("n") * F.col("_d") * F.col("_d") for c in ("x", "y")}
    shift["xy"] = F.col("xy") + F.col("_d") * (F.col("x") + F.col("y")) + F.col("n") * F.col("_d") * F.col("_d")
    total = sums.withColumn("_d", moved).groupBy(*keys, "lag").agg(*[F.sum(shift[c]).alias(c) for c in _SUMS], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spread = {c: F.col("n") * F.col(f"{c}{c}") - F.col(c) * F.col(c) for c in ("x", "y")}
    defined = (F.col("n") >= least) & (spread["x"] > 1e-12 * F.col("n") * F.col("xx")) & (spread["y"] > 1e-12 * F.col("n") * F.col("yy"))
    r = F.when(defined, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread["x"] * spread["y"]))
    lags = F.least(F.lit(cap).cast("long"), F.col("hi") - F.col("lo") - 1)
    ends = total.select(*keys, "lag", lags.alias("_lags"), defined.alias("_defined"), r.alias("_r"))
    stop = F.when((F.col("lag") <= F.col("_lags")) & (~F.col("_defined") | (F.col("_r") < math.exp(-1))), F.col("lag"))
    ends = ends.groupBy(*keys).agg(F.first("_lags").alias("_lags"), F.min_by("_defined", stop).alias("_whole"), F.min(stop).alias("_stop"))
    tau = F.when(F.col("_lags") < 1, float(cap)).when(~F.col("_whole"), None).otherwise(F.coalesce(F.col("_stop").cast("double"), F.lit(float(cap))))
    return ends.select(*keys, tau.cast("double").alias("tau"))
