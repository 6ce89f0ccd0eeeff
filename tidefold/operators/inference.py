"""Tables of decoding results: means, paired differences, rank correlation, and hierarchical bootstrap."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..functions.ranks import quantiles
from ..model import MARGIN, RESAMPLES, RHO_RESAMPLES, SESSION


def cell_means(decoded: DataFrame) -> DataFrame:
    """CELLS rows: the mean test AUROC over folds of each rung, split, session and task."""
    keys = [F.col("rung").alias("model"), "split", F.col("test_subject").alias("subject"), F.col("test_trial").alias("trial"), "task"]
    return decoded.groupBy(*keys).agg(F.avg("test_auroc").alias("auroc"))


def electrode_means(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean AUROC of each electrode over tasks and folds."""
    return scores.groupBy(*by, "electrode").agg(F.avg("test_auroc").alias("mean_auroc"))


def session_overall(cells: DataFrame, n_tasks: int = 15, keys: Sequence[str] = ("model", *SESSION)) -> DataFrame:
    """Mean over tasks per session and model, of sessions that have all tasks."""
    means = cells.groupBy(*keys).agg(F.avg("auroc").alias("auroc"), F.countDistinct("task").alias("_n"))
    return means.where(F.col("_n") == n_tasks).drop("_n")


def _of(table: DataFrame, model: str, name: str, keys: Sequence[str]) -> DataFrame:
    return table.where(F.col("model") == model).select(*keys, F.col("auroc").alias(name))


def paired_difference(table: DataFrame, a: str, b: str, keys: Sequence[str] = SESSION) -> DataFrame:
    """keys and diff, a minus b, where both are there and numbers."""
    both = _of(table, a, "_a", keys).join(_of(table, b, "_b", keys), list(keys))
    return both.select(*keys, (F.col("_a") - F.col("_b")).alias("diff")).where(is_finite("diff"))


def keys_dropped(table: DataFrame, a: str, b: str, keys: Sequence[str] = SESSION) -> DataFrame:
    """Keys that just one of two models has, sorted."""
    full = _of(table, a, "_a", keys).join(_of(table, b, "_b", keys), list(keys), "full")
    return full.where(F.col("_a").isNull() | F.col("_b").isNull()).select(*keys).orderBy(*keys)


def in_all(table: DataFrame, models: Sequence[str], keys: Sequence[str] = SESSION) -> DataFrame:
    """One row per key that every model has: keys and a column per model."""
    wide = table.where(F.col("model").isin(list(models))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, F.col("auroc"))).alias(m) for m in models], F.countDistinct("model").alias("_n")
    )
    return wide.where(F.col("_n") == len(models)).drop("_n")


def reproduction_stats(mine: DataFrame, published: DataFrame, on: Sequence[str], value: str = "auroc", within: float = 0.01) -> DataFrame:
    """One row: cells that both have, the largest and median absolute difference, and how many lie within."""
    both = mine.select(*on, F.col(value).alias("_mine")).join(published.select(*on, F.col(value).alias("_pub")), list(on))
    both = both.select(F.lit(1).alias("_all"), F.abs(F.col("_mine") - F.col("_pub")).alias("_d"))
    counts = both.groupBy("_all").agg(F.count("*").alias("cells"), F.max("_d").alias("max_abs_diff"), F.count_if(F.col("_d") <= within).alias(f"within_{within:g}".replace(".", "p")))
    middle = quantiles(both, ["_all"], F.col("_d"), {"median_abs_diff": 0.5})
    return counts.join(middle, "_all").select("cells", "max_abs_diff", "median_abs_diff", f"within_{within:g}".replace(".", "p"))


def abs_deviation(cells: DataFrame, keys: Sequence[str] = SESSION, chance: float = 0.5) -> DataFrame:
    """Mean absolute distance from chance over the tasks of a session."""
    return cells.groupBy(*keys).agg(F.avg(F.abs(F.col("auroc") - chance)).alias("dev"))


def median_by(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Median of what isn't NaN, by key, ascending."""
    return quantiles(rows, keys, F.col(value), {name: 0.5}).orderBy(name, *keys)


def mid_rank(column: str, keys: Sequence[str] = ()) -> Column:
    """Average rank of ties, from 1."""
    by, tie = Window.partitionBy(*keys).orderBy(column), Window.partitionBy(*keys, column)
    return F.rank().over(by) + (F.count("*").over(tie) - 1) / 2


def correlation(x: str, y: str) -> Column:
    """Pearson correlation; null, not an error, where one side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman(rows: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """rho by key: Pearson correlation of average ranks. Rows are few here (tasks); a key's rows are ranked together."""
    whole = rows.where(is_finite(x) & is_finite(y))
    ranked = whole.select(*keys, mid_rank(x, keys).alias("_x"), mid_rank(y, keys).alias("_y"))
    return ranked.groupBy(*keys).agg(correlation("_x", "_y").alias("rho"))


def replicate_summary(rows: DataFrame, keys: Sequence[str], truth: str, value: str, error: str, spread: str) -> DataFrame:
    """Per key: the truth, bias, sample SD, RMSE, and median and 95 % quantile of a spread."""
    sums = rows.groupBy(*keys).agg(F.first(truth).alias("truth"), F.avg(error).alias("bias"), F.stddev_samp(value).alias("sd"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"))
    return sums.join(quantiles(rows, keys, F.col(spread), {"median": 0.5, "p95": 0.95}), list(keys))


def extent(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Least, median and largest value by key, such as a solver's iterations by rung."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("largest"))
    return ends.join(quantiles(rows, keys, F.col(value), {"median": 0.5}), list(keys)).select(*keys, "least", "median", "largest")


def suffix_means(rows: DataFrame, suffix: str = "jaccard") -> DataFrame:
    """One row: the mean of every column whose name ends so."""
    return rows.agg(*[F.avg(c).alias(c) for c in rows.columns if c.endswith(suffix)])


def with_suffix(cells: DataFrame, suffix: str) -> DataFrame:
    """Cells of a variant, their models renamed, to be put beside the others."""
    return cells.withColumn("model", F.concat("model", F.lit(suffix)))


def variant_difference(primary: DataFrame, variant: DataFrame, model: str, suffix: str, n_tasks: int = 15) -> DataFrame:
    """Session differences of a model, variant minus primary."""
    both = primary.unionByName(with_suffix(variant, suffix), allowMissingColumns=True)
    return paired_difference(session_overall(both, n_tasks), f"{model}{suffix}", model)


def inflation(circular: DataFrame, crossfit: DataFrame, n_tasks: int = 15) -> DataFrame:
    """(model, subject, trial, circular, crossfit, diff): what selecting on the evaluated data adds."""
    a, b = (session_overall(c, n_tasks).withColumnRenamed("auroc", name) for c, name in ((circular, "circular"), (crossfit, "crossfit")))
    return a.join(b, ["model", *SESSION]).withColumn("diff", F.col("circular") - F.col("crossfit"))


def compare(cells: DataFrame, a: str, b: str, n_tasks: int = 15, name: str | None = None, resamples: int = RESAMPLES) -> DataFrame:
    """One row of a paired comparison: comparison, a, b, n_sessions, sessions_dropped, mean_diff, ci_lo, ci_hi.

    Sessions count where both models have all tasks; sessions_dropped are those that just one of them has, as "subject_trial"
    by subject and trial. A pair without a common session gives no row.
    """
    name = name or f"{a}-{b}"
    overall = session_overall(cells.where(F.col("model").isin(a, b)), n_tasks)
    interval = hier_boot(paired_difference(overall, a, b).withColumn("comparison", F.lit(name)), resamples=resamples)
    tags = F.transform(F.array_sort(F.collect_list(F.struct(*SESSION))), lambda s: F.concat_ws("_", s[SESSION[0]], s[SESSION[1]]))
    dropped = keys_dropped(overall, a, b).agg(tags.alias("sessions_dropped")).withColumn("comparison", F.lit(name))
    both = interval.join(dropped, "comparison")
    return both.select("comparison", F.lit(a).alias("a"), F.lit(b).alias("b"), "n_sessions", "sessions_dropped", F.col("mean").alias("mean_diff"), "ci_lo", "ci_hi")


def compare_tasks(cells: DataFrame, a: str, b: str, tau: DataFrame | None = None, prefix: str = "fig", resamples: int = RESAMPLES) -> DataFrame:
    """task, n_sessions, mean, ci_lo, ci_hi of the paired difference in each task, and tau (task, tau) where it's given.

    With tau, rows are in order of it, then of the mean; a task without one comes last, its tau null.
    """
    diff = paired_difference(cells, a, b, (*SESSION, "task"))
    out = hier_boot(diff.withColumn("comparison", F.concat(F.lit(f"{prefix}_{a}_{b}_"), "task")), resamples=resamples)
    out = out.withColumn("task", F.substring("comparison", len(f"{prefix}_{a}_{b}_") + 1, 1 << 30)).select("task", "n_sessions", "mean", "ci_lo", "ci_hi")
    if tau is None:
        return out
    return out.join(tau.select("task", "tau"), "task", "left").orderBy(F.col("tau").asc_nulls_last(), "mean")


def converged_minus_default(default: DataFrame, converged: DataFrame, n_tasks: int = 15, suffix: str = "_conv", resamples: int = RESAMPLES) -> DataFrame:
    """model, n_sessions, mean, ci_lo, ci_hi, default, converged: what a tighter tolerance adds to each model's scores.

    default and converged are the means over the sessions that have all tasks at both.
    """
    both = session_overall(default.unionByName(with_suffix(converged, suffix), allowMissingColumns=True), n_tasks)
    late = both.where(F.col("model").endswith(suffix)).select(F.substring("model", 1, F.length("model") - len(suffix)).alias("model"), *SESSION, F.col("auroc").alias("_late"))
    pairs = both.join(late, ["model", *SESSION]).withColumn("diff", F.col("_late") - F.col("auroc"))
    means = pairs.groupBy("model").agg(F.avg("auroc").alias("default"), F.avg("_late").alias("converged"))
    rows = hier_boot(pairs.withColumn("comparison", F.concat(F.lit("D4_"), "model")), resamples=resamples).withColumn("model", F.substring("comparison", 4, 1 << 30))
    return rows.join(means, "model").select("model", "n_sessions", "mean", "ci_lo", "ci_hi", "default", "converged")


def contrast(differences: DataFrame, plus: Sequence[str] = ("L1", "L5"), minus: Sequence[str] = ("L2", "L4")) -> DataFrame:
    """Per session that has all of them: the mean difference of some models minus that of others."""
    wide = in_all(differences.select("model", *SESSION, F.col("diff").alias("auroc")), [*plus, *minus])
    mean = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    return wide.select(*SESSION, (mean(plus) - mean(minus)).alias("diff"))


def equivalent(lo: str = "ci_lo", hi: str = "ci_hi", margin: float = MARGIN) -> Column:
    return (F.col(lo) > -margin) & (F.col(hi) < margin)


def off_chance(lo: str = "ci_lo", hi: str = "ci_hi", chance: float = 0.5) -> Column:
    return (F.col(lo) > chance) | (F.col(hi) < chance)


def _draws(rng: np.random.Generator, groups: dict) -> list:
    """One resample: groups with replacement, then members of each drawn group. The order of draws is part of the result."""
    members = [groups[g] for g in sorted(groups)]
    return [v for k in rng.integers(0, len(members), len(members)) for v in members[k][rng.integers(0, len(members[k]), len(members[k]))].tolist()]


def hier_boot(values: DataFrame, name: str = "comparison", value: str = "diff", resamples: int = RESAMPLES) -> DataFrame:
    """(comparison, n_sessions, mean, ci_lo, ci_hi): 95 % intervals of session means, subjects then sessions resampled.

    One group is a comparison with a row per session: some dozen, whatever the data behind them. Each is seeded with the
    CRC-32 of its name, so results don't depend on how groups are dealt out. Values of a subject are in order of trial.
    """

    def boot(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["subject", "trial"])
        groups = {s: g["v"].to_numpy() for s, g in rows.groupby("subject")}
        rng = np.random.default_rng(zlib.crc32(str(key[0]).encode()))
        stats = [np.mean(_draws(rng, groups)) for _ in range(resamples)]
        lo, hi = np.quantile(stats, [0.025, 0.975])
        return pd.DataFrame({"comparison": [key[0]], "n_sessions": [len(rows)], "mean": [rows["v"].mean()], "ci_lo": [lo], "ci_hi": [hi]})

    rows = values.select(F.col(name).alias("comparison"), *SESSION, F.col(value).alias("v"))
    return rows.groupBy("comparison").applyInPandas(boot, "comparison string, n_sessions long, mean double, ci_lo double, ci_hi double")


def _rho(x: np.ndarray, y: np.ndarray) -> float:
    a, b = (pd.Series(v).rank().to_numpy() for v in (x, y))
    return float("nan") if a.std() == 0 or b.std() == 0 else float(np.corrcoef(a, b)[0, 1])


def spearman_boot(per_task: DataFrame, tau: DataFrame, name: str = "H4", value: str = "diff", resamples: int = RHO_RESAMPLES) -> DataFrame:
    """(comparison, rho, ci_lo, ci_hi) of tau against task means; a session drawn twice counts twice.

    per_task has a row per (subject, trial, task), tau a row per (task, tau): tables of results, hundreds of rows.
    """

    def boot(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["subject", "trial", "task"])
        place = {t: k for k, t in enumerate(sorted(rows["task"].unique()))}
        taus = rows.drop_duplicates("task").set_index("task")["tau"].reindex(list(place)).to_numpy(float)
        sums, counts, trials = {}, {}, {}
        for (s, t), g in rows.groupby(["subject", "trial"]):
            at = g["task"].map(place).to_numpy()
            sums[s, t], counts[s, t] = np.bincount(at, g["v"], len(place)), np.bincount(at, minlength=len(place))
            trials.setdefault(s, []).append(t)

        def rho(drawn: list) -> float:
            n = sum(counts[d] for d in drawn)
            have = n > 0
            return _rho(taus[have], sum(sums[d] for d in drawn)[have] / n[have])

        rng = np.random.default_rng(zlib.crc32(name.encode()))
        subjects, stats = sorted(trials), []
        for _ in range(resamples):
            drawn = []
            for s in rng.choice(subjects, size=len(subjects), replace=True):
                drawn += [(s, t) for t in rng.choice(trials[s], size=len(trials[s]), replace=True)]
            stats.append(rho(drawn))
        lo, hi = np.nanquantile(stats, [0.025, 0.975])
        return pd.DataFrame({"comparison": [name], "rho": [rho(list(sums))], "ci_lo": [lo], "ci_hi": [hi]})

    rows = per_task.where(is_finite(value)).join(tau.select("task", "tau"), "task", "left").select(*SESSION, "task", F.col(value).alias("v"), "tau", F.lit(1).alias("_all"))
    return rows.groupBy("_all").applyInPandas(lambda g: boot(g), "comparison string, rho double, ci_lo double, ci_hi double")
