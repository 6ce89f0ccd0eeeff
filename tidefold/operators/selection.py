"""Electrode selection by ranked runs of neighbouring contacts, and overlaps of selections."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import QUOTA


def stem(name: Column) -> Column:
    """The name up to its last letter."""
    return F.regexp_extract(name, r"^(.*\p{L})?(-?[0-9]+)$", 1)


def contact(name: Column) -> Column:
    """The number behind the last letter; a name without one raises an error."""
    digits = F.regexp_extract(name, r"^(.*\p{L})?(-?[0-9]+)$", 2)
    return F.when(digits == "", F.raise_error(F.concat(F.lit("no contact number: "), name))).otherwise(digits.cast("int"))


def parse_names(electrodes: DataFrame, column: str = "electrode") -> DataFrame:
    """Electrodes with stem and num."""
    return electrodes.withColumn("stem", stem(F.col(column))).withColumn("num", contact(F.col(column)))


def streak_members(electrodes: DataFrame, column: str = "electrode", by: Sequence[str] = ()) -> DataFrame:
    """Electrodes with stem, num and island: runs of consecutive numbers on a stem share an island."""
    parsed = parse_names(electrodes, column)
    along = Window.partitionBy(*by, "stem").orderBy("num")
    return parsed.withColumn("island", F.col("num") - F.row_number().over(along))


def streaks(electrodes: DataFrame, column: str = "electrode", by: Sequence[str] = ()) -> DataFrame:
    """Maximal runs: stem, island, len, lo, hi."""
    return streak_members(electrodes, column, by).groupBy(*by, "stem", "island").agg(F.count("*").alias("len"), F.min("num").alias("lo"), F.max("num").alias("hi"))


def select_electrodes(scores: DataFrame, quota: int = QUOTA, column: str = "electrode", score: str = "mean_auroc", by: Sequence[str] = ()) -> DataFrame:
    """(pos, electrode): runs by mean score, best first, without runs of one, until quota - 1 or quota are taken.

    Electrodes of a run come in number order; a run that passes the quota is cut there. Ties go by stem, then longer run,
    then first number. A run without any score raises an error. `by` selects within each group, such as a session.
    """
    by = list(by)
    members = streak_members(scores, column, by)
    run = [*by, "stem", "island"]
    known = F.when(~F.isnan(F.col(score)), F.col(score))
    runs = members.groupBy(*run).agg(F.avg(known).alias("_mean"), F.count("*").alias("_len"), F.min("num").alias("_lo"))
    none = F.when(F.col("_mean").isNull(), F.raise_error(F.lit("a run has no scored electrode")))
    order = Window.partitionBy(*by).orderBy(F.desc("_mean"), "stem", F.desc("_len"), "_lo")
    ranked = runs.withColumn("_none", none).where("_none is null and _len > 1").withColumn("_before", F.coalesce(F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = members.join(ranked.where(F.col("_before") < quota - 1), run)
    placed = taken.withColumn("pos", (F.col("_before") + F.col("num") - F.col("_lo") + 1).cast("int"))
    return placed.where(F.col("pos") <= quota).select(*by, "pos", F.col(column).alias("electrode"))


def overlap(a: DataFrame, b: DataFrame, column: str = "electrode") -> DataFrame:
    """One row: sizes of two sets, shared members and Jaccard overlap (0 for two empty sets)."""
    x, y = (f.select(column).where(F.col(column).isNotNull()).distinct().withColumn(k, F.lit(1)) for f, k in ((a, "_a"), (b, "_b")))
    n = x.join(y, column, "full").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared"), F.count("*").alias("_all"))
    return n.select("n_a", "n_b", "shared", (F.col("shared") / F.greatest(F.col("_all"), F.lit(1))).alias("jaccard"))


def partner_scores(scores: DataFrame, subject: str = "subject", trial: str = "trial") -> DataFrame:
    """Each session with the scores of the other session of its subject: (subject, trial, partner_trial, ...)."""
    sessions = scores.select(F.col(subject), F.col(trial).alias("_mine")).distinct()
    return scores.join(sessions, subject).where(F.col(trial) != F.col("_mine")).withColumnRenamed(trial, "partner_trial").withColumnRenamed("_mine", trial)


def keep_known(ordered: DataFrame, known: DataFrame, column: str = "electrode") -> DataFrame:
    """Rows whose electrode is known, their order column kept."""
    return ordered.join(known.select(column), column, "left_semi")


def unknown(wanted: DataFrame, known: DataFrame, column: str = "electrode") -> DataFrame:
    """Wanted electrodes that aren't known."""
    return wanted.join(known.select(column), column, "left_anti")


def only_sessions(rows: DataFrame, tags: Sequence[str], subject: str = "subject", trial: str = "trial") -> DataFrame:
    """Rows of the sessions in a list of tags such as "1_2"; a tag that names none is an error."""
    found = [re.fullmatch(r"[A-Za-z]*(\d+)_t?(\d+)", t.strip()) for t in tags]
    if None in found:
        raise ValueError(f"not a session: {tags[found.index(None)]!r}")
    wanted = [F.struct(F.lit(int(m[1])).alias("a"), F.lit(int(m[2])).alias("b")) for m in found]
    return rows.where(F.struct(F.col(subject).cast("int").alias("a"), F.col(trial).cast("int").alias("b")).isin(*wanted) if wanted else F.lit(False))


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order: for looking at, a limit that is the feature."""
    return rows.orderBy(*order).limit(n)
