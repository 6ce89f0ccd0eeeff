"""Features of (window, channel) rows, quality filters, and the guards before a model sees them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import array_mean, array_sum, bind, col, is_finite, null_to_nan, refuse
from ..model import FS, PLATEAU, Q_ALL, STFT, WINDOW_SAMPLES
from . import fluctuation


def variance(samples: str | Column) -> Column:
    """Population variance of an array."""
    x = F.transform(col(samples), lambda v: v.cast("double"))
    return bind(x, lambda a: bind(array_mean(a), lambda m: array_mean(F.transform(a, lambda v: (v - m) * (v - m)))))


def log_variance(samples: str | Column, undefined: str = "error") -> Column:
    """ln of the variance. Zero variance raises an error, or is NaN (undefined="nan")."""

    def logged(v: Column) -> Column:
        if undefined == "nan":
            return null_to_nan(F.when(v > 0, F.ln(v)))
        return refuse(~(v > 0), "a window has zero variance", F.ln(v))

    return bind(variance(samples), logged)


def shape_only(values: str | Column, undefined: str = "error") -> Column:
    """Each value over the array's total. A total of zero or less raises an error, or gives NaN."""
    x = F.transform(col(values), lambda v: v.cast("double"))

    def shares(a: Column) -> Column:
        def over(total: Column) -> Column:
            good = F.transform(a, lambda v: v / F.when(total > 0, total))
            if undefined == "nan":
                return F.transform(good, null_to_nan)
            return refuse(~(total > 0), "a spectrogram has no mass", good)

        return bind(array_sum(a), over)

    return bind(x, shares)


def q_subset(hq: str | Column, have: Sequence[float], want: Sequence[float]) -> Column:
    """The exponents at some of the moments an array holds."""
    return F.array(*[F.get(col(hq), F.lit(list(have).index(q))) for q in want])


def amplitude_and_dynamics(l1: str | Column, hq: str | Column) -> Column:
    return F.concat(F.array(col(l1)), col(hq))


def flatten_channels(rows: DataFrame, keys: Sequence[str], place: str, features: str) -> DataFrame:
    """One row per key: the feature arrays of its channels joined in the order of their place."""
    one = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(features).alias("x"))))
    return rows.groupBy(*keys).agg(one.alias("_all")).select(*keys, F.flatten(F.transform("_all", lambda s: s["x"])).alias("features"))


def keep_unflat(windows: DataFrame, keys: Sequence[str], run: str = "run", below: int = PLATEAU) -> DataFrame:
    """Keys of windows with kept: no channel has a constant run of `below` samples or more.

    Below the smallest scale windows are free of plateaus; below the window's length no channel is constant.
    """
    return windows.groupBy(*keys).agg((F.max(run) < below).alias("kept"))


def keep_not_constant(windows: DataFrame, keys: Sequence[str], run: str = "run", n: int = WINDOW_SAMPLES) -> DataFrame:
    return keep_unflat(windows, keys, run, n)


def exclusion_counts(kept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n_kept and n_excluded, for all or by keys."""
    return kept.groupBy(*keys).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_excluded"))


def flat_window_counts(windows: DataFrame, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """n_windows and n_flat of channels with any constant window."""
    flat = F.array_max(samples) == F.array_min(samples)
    return windows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if(flat).alias("n_flat")).where("n_flat > 0")


def refuse_non_finite(features: str | Column, what: str = "feature") -> Column:
    """The array; an error that tells how many of its values aren't finite, if any: values are never made up."""
    n = lambda a: F.size(F.filter(a, lambda v: ~is_finite(v)))
    return bind(col(features), lambda a: refuse(n(a) > 0, F.concat(n(a).cast("string"), F.lit(f" non-finite {what} values")), a))


def gather(traces: DataFrame, starts: DataFrame, keys: Sequence[str], n: int = WINDOW_SAMPLES, trace: str = "trace") -> DataFrame:
    """Windows of n samples of each trace from each start of its keys; half-open, samples count from 0.

    Starts of a key are collected into one array and cut from the trace where it lies, so traces are joined once.
    A start that doesn't leave n samples raises an error.
    """
    lists = starts.groupBy(*keys).agg(F.array_sort(F.collect_set("window_from")).alias("_starts"))
    every = traces.join(lists, list(keys)).select("*", F.explode("_starts").alias("window_from")).drop("_starts")
    short = (F.col("window_from") < 0) | (F.col("window_from") + n > F.size(trace))
    cut = F.slice(trace, (F.col("window_from") + 1).cast("int"), F.lit(n))
    return every.withColumn("samples", refuse(short, "a window leaves its trace", cut)).drop(trace)


#: Samples of a bin in which chunks and windows meet.
BIN = 1 << 16


def chunked(traces: DataFrame, length: int, trace: str = "trace", at: str = "chunk_from") -> DataFrame:
    """Traces cut into chunks of a length, the last one shorter, each with the place of its first sample; none of an empty trace."""
    places = F.when(F.size(trace) > 0, F.sequence(F.lit(0).cast("long"), F.size(trace).cast("long") - 1, F.lit(length).cast("long")))
    every = traces.withColumn(at, F.explode(places))
    return every.withColumn(trace, F.slice(trace, (F.col(at) + 1).cast("int"), F.lit(length)))


def gather_chunks(
    chunks: DataFrame, starts: DataFrame, keys: Sequence[str], channels: Sequence[str] = (), n: int = WINDOW_SAMPLES, trace: str = "trace", at: str = "chunk_from", bin_samples: int = BIN,
) -> DataFrame:
    """keys, channels, window_from and samples: gather() from recordings kept in chunks of any length, in any order.

    Each chunk has some samples from the place `at`. Chunks and windows meet in bins of `bin_samples`: a chunk is cut at the
    borders of bins, a window looks into the bins it covers, and what it finds there is put together in order; so a row
    holds a chunk or a window, never a recording. Starts that are there twice count once; keys without chunks have no windows. A
    window that its channel's chunks don't cover, or cover twice, is an error.
    """
    keys, channels = list(keys), list(channels)
    wide = lambda c: F.expr(f"{c} div {bin_samples}")
    held = chunks.where(F.size(trace) > 0).select(*keys, *channels, F.col(at).cast("long").alias("_at"), F.col(trace).alias("_x"))
    binned = held.withColumn("_bin", F.explode(F.sequence(wide("_at"), wide("(_at + size(_x) - 1)"))))
    lo, hi = F.greatest("_at", F.col("_bin") * bin_samples), F.least(F.col("_at") + F.size("_x"), (F.col("_bin") + 1) * bin_samples)
    pieces = binned.select(*keys, *channels, "_bin", lo.alias("_lo"), hi.alias("_hi"), F.slice("_x", (lo - F.col("_at") + 1).cast("int"), (hi - lo).cast("int")).alias("_x"))
    windows = starts.select(*keys, F.col("window_from").cast("long").alias("window_from")).distinct()
    looked = windows.withColumn("_bin", F.explode(F.sequence(wide("window_from"), wide(f"(window_from + {n - 1})"))))
    met = pieces.join(looked, [*keys, "_bin"])
    lo, hi = F.greatest("_lo", "window_from"), F.least(F.col("_hi"), F.col("window_from") + n)
    piece = F.struct(lo.alias("lo"), hi.alias("hi"), F.slice("_x", (lo - F.col("_lo") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    found = met.where(lo < hi).select(*keys, *channels, "window_from", piece.alias("_piece"))
    # a row without a piece for each window of each channel, so that none goes unnoticed
    wanted = windows.join(held.select(*keys, *channels).distinct(), keys).select(*keys, *channels, "window_from", F.lit(None).cast(found.schema["_piece"].dataType).alias("_piece"))
    whole = found.unionByName(wanted).groupBy(*keys, *channels, "window_from").agg(F.array_sort(F.collect_list("_piece")).alias("_all"))
    ends, begins = F.concat(F.array("window_from"), F.transform("_all", lambda p: p["hi"])), F.concat(F.transform("_all", lambda p: p["lo"]), F.array(F.col("window_from") + n))
    samples = refuse(ends != begins, "a window leaves its trace, or chunks overlap", F.flatten(F.transform("_all", lambda p: p["x"])))
    return whole.select(*keys, *channels, "window_from", samples.alias("samples"))


def lookup_all(rows: DataFrame, features: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the features of their key; a row whose key has none raises an error that names it, none is dropped.

    Features have one row a key. A null key has none.
    """
    on = list(on)
    more = [c for c in features.columns if c not in on]
    found = rows.join(features.select(*on, F.struct(*more).alias("_found")), on, "left")
    missing = F.concat(F.lit("no features for "), F.to_json(F.struct(*on), {"ignoreNullFields": "false"}))
    return found.withColumn("_found", refuse(F.col("_found").isNull(), missing, F.col("_found"))).select(*rows.columns, "_found.*")


def undefined_counts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n and n_undefined: how many values are NaN or null, to be told beside a table that keeps them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull() | F.isnan(value)).alias("n_undefined"))


def extract(
    traces: DataFrame, starts: DataFrame, keys: Sequence[str], scales: Sequence[int], q: Sequence[float] = Q_ALL, n: int = WINDOW_SAMPLES, trace: str = "trace", fs: float = FS,
    window: int = STFT["window"], max_hz: float = STFT["max_hz"], at: str | None = None, bin_samples: int = BIN,
) -> DataFrame:
    """traces' columns but the trace, window_from, log_var, hq, run and spec of each window of each electrode.

    A start of a session (keys) is cut from the trace of each of its electrodes: a row's whole trace or, where `at` names
    the column of the first sample's place, chunks of it. Where a window has no variance, log_var
    and hq are NaN (undefined_counts() tells how many), and its run is the whole window. Windows are gathered by a join;
    all else stays in their row.
    """
    if at is None:
        windows = gather(traces, starts, keys, n, trace)
    else:
        channels = [c for c in traces.columns if c not in (*keys, trace, at)]
        windows = gather_chunks(traces, starts, keys, channels, n, trace, at, bin_samples)
    rows = fluctuation.flat_run(windows.withColumn("log_var", log_variance("samples", "nan")))
    rows = fluctuation.hq_of_order(rows, scales, q, 1)
    constant = F.isnan("log_var")
    rows = rows.withColumn("hq", F.transform("hq", lambda h: F.when(constant, F.lit(float("nan"))).otherwise(h)))
    return spectrogram(rows, fs=fs, window=window, max_hz=max_hz).drop("samples")


def spectrogram(windows: DataFrame, samples: str = "samples", fs: float = 2048.0, window: int = STFT["window"], overlap: float = STFT["overlap"], max_hz: float = STFT["max_hz"]) -> DataFrame:
    """Windows with spec: magnitudes of a centred Hann short-time Fourier transform, by time, then frequency.

    Edges are padded with zeros. Windows of one length are transformed together; a null window has a null spec. The
    transform is this library's own; equality with another's is not claimed.
    """
    hop = max(1, round(window * (1 - overlap)))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    bins = int((np.fft.rfftfreq(window, 1 / fs) <= max_hz).sum())
    place = windows.columns.index(samples)
    rows = windows.drop("spec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, at = [], np.full(batch.num_rows, -1)
            for some, x in fluctuation.by_length(batch.column(place)):
                frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (window // 2, window // 2))), window, axis=1)[:, ::hop]
                at[some] = sum(map(len, parts)) + np.arange(len(some))
                parts.append(fluctuation.lists(np.abs(np.fft.rfft(frames * taper, axis=2))[:, :, :bins] / taper.sum()).cast(kind))
            made = pa.chunked_array(parts, kind).combine_chunks().take(pa.array(at, mask=at < 0)) if parts else pa.nulls(batch.num_rows, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "spec"])

    kind = pa.list_(pa.list_(pa.float64()))
    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("array<array<double>>").alias("spec")).schema)


def region_means(features: DataFrame, regions: DataFrame, shared: DataFrame, keys: Sequence[str], feature: str = "value") -> DataFrame:
    """Means of a feature over the electrodes of each region that is in `shared` (regions present in both subjects)."""
    labelled = features.join(regions, "electrode").join(shared.select("region").distinct(), "region", "left_semi")
    return labelled.groupBy(*keys, "region").agg(F.avg(feature).alias(feature))
