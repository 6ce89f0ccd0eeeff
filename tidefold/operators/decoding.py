"""AUROC, the time-only rung in closed form, scaling, and regularised logistic decoding per cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite, refuse, seconds
from ..functions.ranks import running
from ..model import CELL, FS
from .features import lookup_all


def auroc(scores: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """auroc by key: the share of (1, 0) pairs ordered right, ties half. Null where a key lacks a class.

    Rows with another label or none are left out; a score that isn't finite raises an error. Scores are counted by value
    first, so ties are one row; then they are cut into even ranges that are sorted apart, so a key of any size is spread over many tasks.
    """
    keys = list(keys)
    known = scores.where(F.col(label).isin(0, 1)).select(*keys, F.coalesce(F.col(score).cast("double"), F.lit(float("nan"))).alias("_s"), F.col(label).alias("_l"))
    counts = known.groupBy(*keys, "_s").agg(F.count_if(F.col("_l") == 1).alias("_p"), F.count_if(F.col("_l") == 0).alias("_n"))
    pairs = running(counts, keys, "_s", "_n", "_under").withColumn("_w", F.col("_p") * (2 * F.col("_under") + F.col("_n")))
    area = F.try_divide(F.sum("_w").cast("double"), F.nullif(F.lit(2.0) * F.sum("_p") * F.sum("_n"), F.lit(0.0)))
    areas = pairs.groupBy(*keys).agg(area.alias("_area"), F.max(~is_finite("_s")).alias("_bad"))  # one place raises, in the last stage
    return areas.select(*keys, refuse(F.col("_bad"), "a score is not finite", F.col("_area")).alias("auroc"))


def known_labels(rows: DataFrame, model_labels: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label the model knows."""
    return rows.join(model_labels.select(label).distinct(), label, "left_semi")


def time_only_auroc(index: DataFrame, time_col: str = "window_from", cell: Sequence[str] = CELL, fs: float = FS) -> DataFrame:
    """auroc by cell of a logistic model of one feature, the window's start time.

    One standardised feature gets a weight of the sign of its covariance with the label on train rows, and AUROC needs
    the order alone: so it's the AUROC of time itself, turned round where the covariance is negative, one half where
    it's zero. No model is fitted.
    """
    cell = list(cell)
    rows = index.dropna(subset=cell).where(F.col("label").isin(0, 1))
    rows = rows.withColumn("_t", seconds(time_col, fs))
    of = lambda c: F.when(F.col("role") == "train", c)
    y = F.col("label").cast("double")
    # the sign of the covariance is that of the difference of class means
    sign = rows.groupBy(*cell).agg((F.avg(of(F.when(y == 1, F.col("_t")))) - F.avg(of(F.when(y == 0, F.col("_t"))))).alias("_d"))
    area = auroc(rows.where(F.col("role") == "test"), cell, "_t")
    turned = F.when(F.col("_d") > 0, F.col("auroc")).when(F.col("_d") < 0, 1 - F.col("auroc")).when(F.col("auroc").isNotNull(), 0.5)
    return area.join(sign, cell).select(*cell, turned.alias("auroc"))


def standardize(rows: DataFrame, value: str | Column, keys: Sequence[str] = CELL, name: str = "z") -> DataFrame:
    """Train and test rows with z: value less the train mean over the train population SD (1 where that is 0)."""
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    used = rows.where(F.col("role").isin("train", "test")).withColumn("_v", value.cast("double"))
    fit = used.where(F.col("role") == "train").groupBy(*keys).agg(F.avg("_v").alias("_mean"), F.stddev_pop("_v").alias("_sd"))
    scale = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return used.join(fit, keys).withColumn(name, (F.col("_v") - F.col("_mean")) / scale).drop("_v", "_mean", "_sd")


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, tol: float = 1e-8, max_iter: int = 200) -> tuple[np.ndarray, float, int]:
    """Weights, intercept and Newton steps of an L2-regularised logistic model; the intercept is free.

    With more features than rows the weights lie in the rows' span, so the system solved has the smaller size.
    """
    if x.shape[1] > len(x):
        basis, keep, _ = np.linalg.svd(x.T, full_matrices=False)
        basis = basis[:, keep > 1e-12 * max(keep.max(initial=0), 1e-300)]
        w, b, n = fit_logistic(x @ basis, y, c, tol, max_iter)
        return basis @ w, b, n
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1.0 / c), 0.0)
    beta = np.zeros(a.shape[1])
    loss = lambda v: np.logaddexp(0, -(2 * y - 1) * (a @ v)).sum() + 0.5 * (ridge * v * v).sum()
    for step in range(1, max_iter + 1):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -500, 500)))
        gradient = a.T @ (p - y) + ridge * beta
        if np.abs(gradient).max(initial=0) < tol * max(1, len(x)):
            return beta[:-1], float(beta[-1]), step - 1
        move = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(ridge + 1e-12), gradient)
        size = 1.0
        while size > 1e-6 and loss(beta - size * move) > loss(beta) - 1e-4 * size * gradient @ move:
            size /= 2
        beta = beta - size * move
    return beta[:-1], float(beta[-1]), max_iter


def fit_many(x: np.ndarray, y: np.ndarray, used: np.ndarray, c: float = 1.0, tol: float = 1e-8, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fit_logistic() of many models at once: x is models x rows x features, y and used (1, or 0 for padding) models x rows.

    All models take their Newton steps together, each with its own step size, and drop out as they converge.
    """
    k, _, d = x.shape
    a = np.concatenate([x, np.ones((*x.shape[:2], 1))], axis=2)
    ridge = np.append(np.full(d, 1.0 / c), 0.0)
    beta, steps, open_ = np.zeros((k, d + 1)), np.zeros(k, int), np.arange(k)
    n = np.maximum(1, used.sum(axis=1))

    def loss(at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (used[at] * np.logaddexp(0, -(2 * y[at] - 1) * np.einsum("knd,kd->kn", a[at], v))).sum(axis=1) + 0.5 * (ridge * v * v).sum(axis=1)

    for step in range(max_iter + 1):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("knd,kd->kn", a[open_], beta[open_]), -500, 500)))
        gradient = np.einsum("knd,kn->kd", a[open_], used[open_] * (p - y[open_])) + ridge * beta[open_]
        go = (np.abs(gradient).max(axis=1, initial=0) >= tol * n[open_]) & (step < max_iter)
        steps[open_] = step
        open_, p, gradient = open_[go], p[go], gradient[go]
        if not len(open_):
            break
        weight = used[open_] * p * (1 - p)
        h = np.matmul(a[open_].transpose(0, 2, 1) * weight[:, None, :], a[open_]) + np.diag(ridge + 1e-12)
        move = np.linalg.solve(h, gradient[:, :, None])[:, :, 0]
        slope, now, size = (gradient * move).sum(axis=1), loss(open_, beta[open_]), np.ones(len(open_))
        tried = np.arange(len(open_))
        while len(tried := tried[(size[tried] > 1e-6) & (loss(open_[tried], beta[open_[tried]] - size[tried, None] * move[tried]) > now[tried] - 1e-4 * size[tried] * slope[tried])]):
            size[tried] /= 2
        beta[open_] -= size[:, None] * move
    return beta[:, :-1], beta[:, -1], steps


def rank_auroc(score: np.ndarray, y: np.ndarray) -> float:
    pos, neg = int((y == 1).sum()), int((y != 1).sum())
    if not pos or not neg:
        return float("nan")
    ranks = pd.Series(score).rank().to_numpy()
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))


RESULT = "n_train long, n_test long, n_features int, test_auroc double, train_auroc double, n_iter int"


def decode_cells(rows: DataFrame, keys: Sequence[str] = CELL, features: str = "features", tol: float = 1e-8, c: float = 1.0) -> DataFrame:
    """keys and RESULT: scale on train, fit, and AUROC on test and train rows, a task per cell.

    rows: keys, role, item, label, features (array<double>). A cell is one fold of one task of a session: some thousand
    windows, a bound that the experiment sets; cells run in parallel and fail alone. Rows are ordered by item, so
    results don't depend on partitioning. Features that aren't finite raise an error with their count; so does a cell
    without train or test rows. Labels other than the two of a cell's train rows are left out of its test rows; macro
    averages over classes are taken where train rows have more than two.
    """
    keys = list(keys)
    used = rows.where(F.col("role").isin("train", "test")).select(*keys, "role", "item", "label", F.col(features).alias("_x"))
    kinds = ", ".join(f"`{k}` {used.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("item", kind="stable")
        x, y, train = np.stack(g["_x"].to_numpy()).astype(float), g["label"].to_numpy(), (g["role"] == "train").to_numpy()
        for name, part in (("train", x[train]), ("test", x[~train])):
            if not len(part):
                raise ValueError(f"cell {key}: no {name} rows")
            if bad := int((~np.isfinite(part)).sum()):
                raise ValueError(f"cell {key}: {bad} non-finite {name} feature values")
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        x = (x - mean) / np.where(sd > 0, sd, 1.0)
        classes = np.unique(y[train])
        known = np.isin(y, classes)
        areas, steps = {True: [], False: []}, 0
        for k in classes[1:] if len(classes) == 2 else classes:
            w, b, n = fit_logistic(x[train], (y[train] == k).astype(float), c, tol)
            steps = max(steps, n)
            for part in (True, False):
                use = known & (train == part)
                areas[part].append(rank_auroc(x[use] @ w + b, (y[use] == k).astype(int)))
        out = {k: [v] for k, v in zip(keys, key, strict=True)}
        return pd.DataFrame(out | {"n_train": [int(train.sum())], "n_test": [int((~train & known).sum())], "n_features": [x.shape[1]], "test_auroc": [np.mean(areas[False])], "train_auroc": [np.mean(areas[True])], "n_iter": [steps]})

    return used.groupBy(*keys).applyInPandas(run, f"{kinds}, {RESULT}")


#: Rows of cells that are fitted in one call, about, and numbers of padded rows that are solved together.
RACK, STACK = 50_000, 1 << 22


def decode_many(rows: DataFrame, keys: Sequence[str] = CELL, features: str = "features", tol: float = 1e-8, c: float = 1.0, rack: int = RACK) -> DataFrame:
    """decode_cells() for very many small cells: some hundreds come to a task together and are solved as one stack.

    Cells are dealt to racks by a hash of their keys, as many racks as all rows take. Within a rack cells of like size
    are padded to one shape, so that a Newton step of all of them is one product and one solution of stacked matrices.
    Rows, rules, errors and results are those of decode_cells().
    """
    keys = list(keys)
    used = rows.where(F.col("role").isin("train", "test")).select(*keys, "role", "item", "label", F.col(features).alias("_x"))
    racks = max(1, -(-used.count() // rack))
    kinds = ", ".join(f"`{k}` {used.schema[k].dataType.simpleString()}" for k in keys)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*keys, "item"], kind="stable")
        x, y, train = np.stack(g["_x"].to_numpy()).astype(float), g["label"].to_numpy(), (g["role"] == "train").to_numpy()
        cell = g.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        models, out = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = g.iloc[a][keys].to_dict()
            for name, part in (("train", x[a:b][train[a:b]]), ("test", x[a:b][~train[a:b]])):
                if not len(part):
                    raise ValueError(f"cell {tuple(own.values())}: no {name} rows")
                if bad := int((~np.isfinite(part)).sum()):
                    raise ValueError(f"cell {tuple(own.values())}: {bad} non-finite {name} feature values")
            t = x[a:b][train[a:b]]
            sd = t.std(axis=0)
            x[a:b] = (x[a:b] - t.mean(axis=0)) / np.where(sd > 0, sd, 1.0)
            classes = np.unique(y[a:b][train[a:b]])
            out.append((own, a, b, np.isin(y[a:b], classes), []))
            models += [(len(out) - 1, k) for k in (classes[1:] if len(classes) == 2 else classes)]
        d = x.shape[1]
        sizes = [1 << int(train[out[i][1] : out[i][2]].sum() - 1).bit_length() for i, _ in models]
        for n in sorted(set(sizes)):
            some = [m for m, size in zip(models, sizes, strict=True) if size == n]
            for at in range(0, len(some), step := max(1, STACK // (n * (d + 1)))):
                stack = some[at : at + step]
                xs, ys, us = np.zeros((len(stack), n, d)), np.zeros((len(stack), n)), np.zeros((len(stack), n))
                for j, (i, k) in enumerate(stack):
                    _, a, b, *_ = out[i]
                    m = train[a:b].sum()
                    xs[j, :m], ys[j, :m], us[j, :m] = x[a:b][train[a:b]], y[a:b][train[a:b]] == k, 1
                for (i, k), w, b0, steps in zip(stack, *fit_many(xs, ys, us, c, tol), strict=True):
                    _, a, b, known, found = out[i]
                    score, hit = x[a:b] @ w + b0, (y[a:b] == k).astype(int)
                    found.append((steps, *(rank_auroc(score[part], hit[part]) for part in (known & ~train[a:b], known & train[a:b]))))
        return pd.DataFrame([
            own | {"n_train": int(train[a:b].sum()), "n_test": int((~train[a:b] & known).sum()), "n_features": d, "test_auroc": np.mean([f[1] for f in found]), "train_auroc": np.mean([f[2] for f in found]), "n_iter": int(max(f[0] for f in found))}
            for own, a, b, known, found in out
        ])

    dealt = used.withColumn("_rack", F.pmod(F.xxhash64(*keys), F.lit(racks)))
    return dealt.groupBy("_rack").applyInPandas(lambda g: run(g), f"{kinds}, {RESULT}")


def _added(rows: DataFrame, cells: Sequence[int], part: Callable) -> dict[int, np.ndarray]:
    """Vectors by cell, added up over all rows: part(x, label, train) gives a vector for each cell of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(v, float) for v in batch.column(0).to_pylist()])
                got = part(x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
                sums = got if sums is None else sums + got
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(list(sums), pa.list_(pa.float64()))], ["task", "s"])

    partial = rows.select("_x", "label", "train").mapInArrow(run, "task long, s array<double>").select("task", F.posexplode("s").alias("pos", "v"))
    out: dict[int, list] = {k: [] for k in cells}
    for r in partial.groupBy("task", "pos").agg(F.sum("v").alias("v")).orderBy("task", "pos").collect():
        out[r["task"]].append(r["v"])
    return {k: np.array(v) for k, v in out.items()}


#: Features from which Hessians, of their square, no longer come to the driver; and the steps that L-BFGS remembers.
WIDE, MEMORY = 512, 10


def decode_labels(rows: DataFrame, features: str = "features", tol: float = 1e-8, c: float = 1.0, max_iter: int = 200, block: int = 64, wide: int = WIDE) -> DataFrame:
    """task (long) and RESULT for each label present, told from all others: what decode_cells() gives for such cells.

    rows: role, label, features (array<double>, of one length). No cell is gathered: each Newton step of all labels of a
    block adds up losses, gradients and Hessians of batches, scores are made in place and ranked by auroc(). From `wide`
    features on the steps are those of L-BFGS, which takes gradients alone: a few vectors of that many numbers are on the driver for each label
    of a block. Rows without a label are left out. Features that aren't finite raise an error with their count; so do tables without
    train or test rows. AUROC is NaN where a label lacks rows on either side.
    """
    used = rows.where(F.col("role").isin("train", "test") & F.col("label").isNotNull())
    used = used.select(F.col(features).alias("_x"), F.col("label").cast("long").alias("label"), (F.col("role") == "train").alias("train"))
    spark = rows.sparkSession
    counts = used.groupBy("label").agg(F.count_if("train").alias("a"), F.count_if(~F.col("train")).alias("b")).orderBy("label").collect()
    n_train, n_test = sum(r["a"] for r in counts), sum(r["b"] for r in counts)
    for name, n in (("train", n_train), ("test", n_test)):
        if counts and not n:
            raise ValueError(f"no {name} rows")

    def first(x: np.ndarray, y: np.ndarray, train: np.ndarray) -> np.ndarray:
        bad = ~np.isfinite(x)
        return np.concatenate([[bad[train].sum(), bad[~train].sum()], np.where(bad, 0, x)[train].sum(axis=0)])[None]

    out = None
    if counts:
        sums = _added(used, [0], first)[0]
        for name, bad in zip(("train", "test"), sums[:2], strict=True):
            if bad:
                raise ValueError(f"{int(bad)} non-finite {name} feature values")
        mean = sums[2:] / n_train
        sd = np.sqrt(_added(used, [0], lambda x, y, train: ((x[train] - mean) ** 2).sum(axis=0)[None])[0] / n_train)
        sd = np.where(sd > 0, sd, 1.0)
        block = max(1, min(block, (1 << 18) // max(1, len(mean))))
        for i in range(0, len(counts), block):
            some = _decode_block(used, counts[i : i + block], n_train, n_test, mean, sd, tol, c, max_iter, len(mean) >= wide)
            out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], f"task long, {RESULT}") if out is None else out


class _Past:
    """What L-BFGS remembers of one model: its last steps and how the gradient changed over each."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.at: tuple[np.ndarray, np.ndarray] | None = None

    def move(self, beta: np.ndarray, gradient: np.ndarray, n: int) -> np.ndarray:
        """The gradient times what the pairs say of the inverse Hessian; a step is against it."""
        if self.at is not None:
            s, g = beta - self.at[0], gradient - self.at[1]
            if s @ g > 1e-12 * (g @ g):
                self.pairs = [*self.pairs[1 - MEMORY :], (s, g)]
        self.at = beta.copy(), gradient
        q, shares = gradient.copy(), []
        for s, g in reversed(self.pairs):
            shares.append((s @ q) / (s @ g))
            q -= shares[-1] * g
        # at first the Hessian is taken to be a quarter of the rows: no logistic curvature of scaled features is larger on average
        q *= (self.pairs[-1][0] @ self.pairs[-1][1]) / (self.pairs[-1][1] @ self.pairs[-1][1]) if self.pairs else 4.0 / max(1, n)
        for (s, g), share in zip(self.pairs, reversed(shares), strict=True):
            q += (share - (g @ q) / (s @ g)) * s
        return q


def _decode_block(used: DataFrame, counts: list, n_train: int, n_test: int, mean: np.ndarray, sd: np.ndarray, tol: float, c: float, max_iter: int, wide: bool) -> DataFrame:
    d = len(mean)
    ridge = np.append(np.full(d, 1.0 / c), 0.0)
    upper = np.triu_indices(0 if wide else d + 1)
    past: dict[int, _Past] = {r["label"]: _Past() for r in counts}
    # with one class in train rows the model tells that class from nothing, as in decode_cells()
    single = {r["label"]: r["a"] in (0, n_train) for r in counts}
    negative = {r["label"]: r["a"] == 0 for r in counts}
    beta = {r["label"]: np.zeros(d + 1) for r in counts}
    state: dict[int, tuple] = {}
    trial = dict(beta)
    steps = dict.fromkeys(beta, 0)
    open_ = dict.fromkeys(beta)  # cell -> (move, size, slope) of the step that is tried
    while open_:
        cells = list(open_)
        at = np.stack([trial[k] for k in cells])

        def part(x: np.ndarray, label: np.ndarray, train: np.ndarray, cells=cells, at=at) -> np.ndarray:
            a = np.column_stack([(x[train] - mean) / sd, np.ones(int(train.sum()))])
            got = np.zeros((len(cells), 1 + d + 1 + len(upper[0])))
            for i, k in enumerate(cells):
                y = ((label[train] == k) != negative[k]).astype(float)
                z = a @ at[i]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                got[i, 0] = np.logaddexp(0, -(2 * y - 1) * z).sum()
                got[i, 1 : d + 2] = a.T @ (p - y)
                if not wide:
                    got[i, d + 2 :] = ((a.T * (p * (1 - p))) @ a)[upper]
            return got

        for k, v in _added(used, cells, part).items():
            loss, gradient = v[0] + 0.5 * (ridge * trial[k] ** 2).sum(), v[1 : d + 2] + ridge * trial[k]
            if open_[k] is not None:
                move, size, slope = open_[k]
                if size > 1e-6 and loss > state[k] - 1e-4 * size * slope:
                    open_[k] = move, size / 2, slope
                    trial[k] = beta[k] - size / 2 * move
                    continue
                beta[k] = trial[k]
                steps[k] += 1
            state[k] = loss
            if np.abs(gradient).max(initial=0) < tol * max(1, n_train) or steps[k] == max_iter:
                del open_[k]
                continue
            if wide:
                move = past[k].move(beta[k], gradient, n_train)
            else:
                h = np.zeros((d + 1, d + 1))
                h[upper] = v[d + 2 :]
                move = np.linalg.solve(h + np.triu(h, 1).T + np.diag(ridge + 1e-12), gradient)
            open_[k] = move, 1.0, gradient @ move
            trial[k] = beta[k] - move
    tasks = list(beta)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (np.stack([np.asarray(v, float) for v in batch.column(0).to_pylist()]) - mean) / sd
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for k in tasks:  # by row, so that equal vectors have equal scores
                s = (x * beta[k][:-1]).sum(axis=1) + beta[k][-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k), pa.int64()), batch.column(2), pa.array(s), pa.array((label == k).astype(np.int32), pa.int32())], ["task", "train", "score", "label"])

    scored = used.mapInArrow(score, "task long, train boolean, score double, label int")
    areas = auroc(scored, ["task", "train"]).groupBy("task").agg(F.max(F.when(~F.col("train"), F.col("auroc"))).alias("test_auroc"), F.max(F.when(F.col("train"), F.col("auroc"))).alias("train_auroc"))
    known = {r["label"]: (n_test - r["b"] if negative[r["label"]] else r["b"]) if single[r["label"]] else n_test for r in counts}
    fits = used.sparkSession.createDataFrame([(k, n_train, known[k], d, steps[k], single[k]) for k in tasks], "task long, n_train long, n_test long, n_features int, n_iter int, single boolean")
    area = lambda n: F.when(F.col("single") | F.col(n).isNull(), F.lit(float("nan"))).otherwise(F.col(n)).alias(n)
    return fits.join(areas, "task", "left").select("task", "n_train", "n_test", "n_features", area("test_auroc"), area("train_auroc"), "n_iter")


def decode_channels(windows: DataFrame, folds: DataFrame, session: Sequence[str], keys: Sequence[str] = ("task", "fold"), samples: str = "samples") -> DataFrame:
    """Each electrode decoded alone from its raw samples: session, electrode, keys and RESULT.

    windows: session, electrode, window_from, samples; folds: session, keys, role, item, label, window_from. A window of
    a fold that isn't there for each electrode of its session raises an error.
    """
    rows = lookup_all(folds.join(windows.select(*session, "electrode").distinct(), list(session)), windows, [*session, "electrode", "window_from"]).withColumnRenamed(samples, "features")
    return decode_many(rows, [*session, "electrode", *keys])


def convergence(rows: DataFrame, keys: Sequence[str] = CELL, loose: float = 1e-3, tight: float = 1e-6) -> DataFrame:
    """Cells decoded at two tolerances: loose and tight AUROC, iterations of each, and their difference."""
    a, b = (decode_many(rows, keys, tol=t).select(*keys, F.col("test_auroc").alias(f"auroc_{n}"), F.col("n_iter").alias(f"iter_{n}")) for n, t in (("loose", loose), ("tight", tight)))
    return a.join(b, list(keys)).withColumn("diff", F.col("auroc_tight") - F.col("auroc_loose"))
