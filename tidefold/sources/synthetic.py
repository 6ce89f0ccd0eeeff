"""Fractional Gaussian noise and Brownian motion of known exponent, by circulant embedding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Signals that a task makes, about, and that are in a worker's memory at once.
TASK, HELD = 1024, 64


def fgn(n: int, hurst: float, seed: int) -> np.ndarray:
    """n steps of unit variance: the covariance of a circle of 2n steps is diagonal under the Fourier transform."""
    k = np.arange(n + 1, dtype=float)
    cov = 0.5 * (np.abs(k + 1) ** (2 * hurst) - 2 * k ** (2 * hurst) + np.abs(k - 1) ** (2 * hurst))
    power = np.maximum(np.fft.fft(np.concatenate([cov, cov[-2:0:-1]])).real, 0)
    rng = np.random.default_rng(seed)
    m = len(power)
    noise = rng.standard_normal(m) + 1j * rng.standard_normal(m)
    return np.fft.fft(np.sqrt(power / m) * noise).real[:n]


def replicates(spark: SparkSession, hursts: Sequence[float] = (0.3, 0.5, 0.7, 0.9), lengths: Sequence[int] = (1024, 2048), reps: int = 30) -> DataFrame:
    """family, exponent, n, rep, seed, truth, samples; seeds follow from the cell alone."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    cells = (
        spark.range(reps).select(F.col("id").cast("int").alias("rep"))
        .withColumn("family", F.explode(array(["fgn", "fbm"])))
        .withColumn("exponent", F.explode(array([float(h) for h in hursts])))
        .withColumn("n", F.explode(array(list(lengths))))
    )
    return noise(dealt(cells))


def dealt(cells: DataFrame) -> DataFrame:
    """Rows dealt evenly to tasks of about TASK rows: what they are made into, some 16 KB a signal, stays small in a worker however many rows there are."""
    return cells.repartition(max(cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // TASK)))


def noise(cells: DataFrame) -> DataFrame:
    """Rows of family (fgn or fbm), exponent, n and rep with seed, truth and samples: a signal for each, made where its row is."""
    brownian = (F.col("family") == "fbm").cast("int")
    cells = cells.withColumn("seed", brownian * 1_000_000 + F.floor(F.round(F.col("exponent") * 10)).cast("int") * 10_000 + F.col("n") * 10 + F.col("rep")).withColumn("truth", F.col("exponent") + brownian)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for i in range(0, len(some), HELD):
                part = some.iloc[i : i + HELD]
                steps = [fgn(int(n), float(h), int(s)) for n, h, s in zip(part["n"], part["exponent"], part["seed"], strict=True)]
                yield part.assign(samples=[np.cumsum(x) if f == "fbm" else x for x, f in zip(steps, part["family"], strict=True)])

    return cells.mapInPandas(run, cells.select("*", F.lit(None).cast("array<double>").alias("samples")).schema)
