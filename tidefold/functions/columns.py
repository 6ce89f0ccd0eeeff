"""Scalar and array expressions, all on the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running sum adds one by one; longer arrays are summed in chunks first.
CHUNK = 64


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once per row: it's bound as the element of an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_finite(c: str | Column) -> Column:
    """Neither null, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def null_to_nan(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(float("nan")))


def half_even(c: str | Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.bround(col(c), 0)


def seconds(c: str | Column, fs: float) -> Column:
    return col(c).cast("double") / F.lit(float(fs))


def session_tag(subject: str | Column, trial: str | Column) -> Column:
    return F.format_string("s%d_t%d", col(subject).cast("int"), col(trial).cast("int"))


def parse_tag(tag: str | Column) -> Column:
    """struct<subject, trial> of tags such as 1_2, s1_t2 or btbank1_2; null for others."""
    got = F.regexp_extract(col(tag), r"^[A-Za-z]*([0-9]+)_t?([0-9]+)$", 1), F.regexp_extract(col(tag), r"^[A-Za-z]*([0-9]+)_t?([0-9]+)$", 2)
    return F.when(got[0] != "", F.struct(got[0].cast("int").alias("subject"), got[1].cast("int").alias("trial")))


def name_seed(name: str | Column) -> Column:
    """CRC-32 of a comparison's name: the seed of its resampling."""
    return F.crc32(col(name).cast("binary"))


def float_key(c: str | Column) -> Column:
    """A number as the text that keys side tables: five decimals."""
    return F.format_string("%.5f", col(c).cast("double"))


def geometric_scales(n: int, smallest: int = 8, count: int = 12, largest: int | None = None) -> list[int]:
    """Distinct log-spaced scales from the smallest to n // 8 (twice the smallest at least), halves rounded to even."""
    top = largest or max(2 * smallest, n // 8)
    step = math.log(top / smallest) / (count - 1)
    inner = [smallest * math.exp(k * step) for k in range(1, count - 1)]
    return sorted({smallest, top, *map(round, inner)})


def scales_of(n: str | Column, smallest: int = 8, count: int = 12) -> Column:
    """geometric_scales() of a column of lengths, as an array of longs."""
    top = F.greatest(F.lit(2 * smallest), F.floor(col(n) / 8)).cast("double")
    inner = lambda k: half_even(smallest * F.exp(k * F.ln(top / smallest) / (count - 1)))
    every = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.when(k == 0, float(smallest)).when(k == count - 1, top).otherwise(inner(k)).cast("long"))
    return F.array_sort(F.array_distinct(every))


def lookup(mapping: Column, key: str | Column, default) -> Column:
    """What a map has for a key, or the default if it has nothing there."""
    return F.coalesce(F.try_element_at(mapping, col(key)), F.lit(default))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda total, x: total + x)


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a))


def array_median(a: Column) -> Column:
    """Middle value, or the mean of the two in the middle; null for none."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    return bind(F.array_sort(a), middle)


def running_sum(a: Column) -> Column:
    """Sums up to each element, itself included, without leaving the row: of whole chunks, then inside the chunk."""

    def of_chunks(chunks: Column) -> Column:
        totals = F.transform(chunks, array_sum)

        def one(chunk: Column, j: Column, before: Column) -> Column:
            return F.transform(chunk, lambda _, i: before + array_sum(F.slice(chunk, F.lit(1), i + 1)))

        return bind(totals, lambda t: F.flatten(F.transform(chunks, lambda chunk, j: bind(array_sum(F.slice(t, F.lit(1), j)), lambda before: one(chunk, j, before)))))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda j: F.slice(a, j * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(a) > 0, bind(chunks, of_chunks)).otherwise(F.array().cast("array<double>"))


def slope(x: Sequence[float], y: Column) -> Column:
    """Least-squares slope of the finite entries of array y on fixed places x; null for under two."""
    at = F.array(*[F.lit(float(v)) for v in x])

    def fitted(points: Column) -> Column:
        n = F.size(points)
        mx = F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]), n)
        my = F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]), n)

        def ratio(m: Column) -> Column:
            top = F.aggregate(points, F.lit(0.0), lambda s, p: s + (p["x"] - m["x"]) * (p["y"] - m["y"]))
            under = F.aggregate(points, F.lit(0.0), lambda s, p: s + (p["x"] - m["x"]) * (p["x"] - m["x"]))
            return F.when(n >= 2, F.try_divide(top, F.nullif(under, F.lit(0.0))))

        return bind(F.struct(mx.alias("x"), my.alias("y")), ratio)

    pairs = F.zip_with(at, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))
    return bind(F.filter(pairs, lambda p: is_finite(p["y"])), fitted)


def longest_run(a: Column, atol: float = 0.0) -> Column:
    """Samples in the longest stretch whose successive differences are atol at most; 1 where there is none."""
    steps = F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda p, q: F.abs(q - p) <= atol)
    start = F.struct(F.lit(1).alias("now"), F.lit(1).alias("most"))

    def step(s: Column, same: Column) -> Column:
        return bind(F.when(same, s["now"] + 1).otherwise(F.lit(1)), lambda now: F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most")))

    return F.aggregate(steps, start, step, lambda s: s["most"])


def refuse(bad: Column, message: str | Column, value: Column) -> Column:
    """value, or an error for rows where bad holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text)).otherwise(value)
