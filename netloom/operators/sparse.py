"""Sparse precision matrices: Graphical Lasso, its regularisation path, selection and resampling.

The estimator minimises -log det T + tr(S T) + alpha * sum |T_ij| over i != j
by block coordinate descent on the covariance; its diagonal isn't penalised.
One fit is one grouped task, so paths, folds, resamples and windows run side by
side; all counting over fits is relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import geomspace, ratio
from ..shipping import apply_groups, map_batches
from .dependence import partial_of, to_dense, to_long

SUPPORT = 1e-8
TOL = 1e-4
INNER_TOL = 1e-6
MAX_ITER = 5000
DENSE_CELLS = 50_000_000


def _lasso(gram: np.ndarray, target: np.ndarray, alpha: float, beta: np.ndarray) -> np.ndarray:
    """Coordinate descent on beta' gram beta / 2 - target' beta + alpha |beta|."""
    fit = gram @ beta
    diagonal = gram.diagonal()
    for _ in range(1000):
        most = 0.0
        for j in range(len(beta)):
            old = beta[j]
            pull = target[j] - fit[j] + diagonal[j] * old
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / diagonal[j]
            if new != old:
                fit += gram[:, j] * (new - old)
                beta[j] = new
                most = max(most, abs(new - old))
        if most <= INNER_TOL * max(np.abs(beta).max(initial=0.0), 1e-12):
            break
    return beta


def graphical_lasso(s: np.ndarray, alpha: float, tol: float = TOL, max_iter: int = MAX_ITER) -> dict:
    """precision, covariance, n_iter, dual_gap, converged."""
    p = len(s)
    if p == 1 or alpha == 0:
        theta = np.linalg.inv(s)
        return {"precision": theta, "covariance": s.copy(), "n_iter": 0, "dual_gap": 0.0, "converged": True}
    cov = 0.95 * s
    np.fill_diagonal(cov, s.diagonal())
    theta, betas = np.linalg.pinv(cov), np.zeros((p, p - 1))
    for j in range(p):
        others = np.arange(p) != j
        betas[j] = -theta[others, j] / theta[j, j]
    gap = np.inf
    for step in range(1, max_iter + 1):
        for j in range(p):
            others = np.arange(p) != j
            gram = cov[np.ix_(others, others)]
            betas[j] = _lasso(gram, s[others, j], alpha, betas[j])
            column = gram @ betas[j]
            cov[others, j] = cov[j, others] = column
            theta[j, j] = 1.0 / (s[j, j] - column @ betas[j])
            theta[others, j] = theta[j, others] = -theta[j, j] * betas[j]
        gap = float((s * theta).sum() - p + alpha * (np.abs(theta).sum() - np.abs(theta.diagonal()).sum()))
        if not np.isfinite(theta).all():
            return {"precision": theta, "covariance": cov, "n_iter": step, "dual_gap": gap, "converged": False}
        if abs(gap) < tol:
            return {"precision": theta, "covariance": cov, "n_iter": step, "dual_gap": gap, "converged": True}
    return {"precision": theta, "covariance": cov, "n_iter": max_iter, "dual_gap": gap, "converged": False}


def partial_matrix(theta: np.ndarray) -> np.ndarray:
    scale = np.sqrt(theta.diagonal())
    out = -theta / np.outer(scale, scale)
    np.fill_diagonal(out, 1.0)
    return out


def glasso(matrix: DataFrame, alpha: float) -> DataFrame:
    """(row, col, value, n_iter, dual_gap, converged) of the sparse precision matrix of a covariance or correlation matrix."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names, s = to_dense(rows)
        r = graphical_lasso(s, alpha)
        return to_long(names, r["precision"]).assign(n_iter=r["n_iter"], dual_gap=r["dual_gap"], converged=r["converged"])

    return apply_groups(matrix, [], fit, "row string, col string, value double, n_iter int, dual_gap double, converged boolean")


def support(precision: DataFrame) -> DataFrame:
    """(e1, e2, precision, weight) of the pairs with a non-zero entry; weight is the partial correlation."""
    partial = partial_of(precision.select("row", "col", "value")).select("row", "col", F.col("value").alias("weight"))
    return precision.select("row", "col", F.col("value").alias("precision")).join(partial, ["row", "col"]).filter(f"row < col AND abs(precision) > {SUPPORT}").select(F.col("row").alias("e1"), F.col("col").alias("e2"), "precision", "weight")


# --- path and selection --------------------------------------------------------------------------------------


def dense_panel(returns: DataFrame) -> tuple[list[str], np.ndarray]:
    """Entities and the listwise-complete n*p array; the size is checked before anything is collected."""
    n, p = returns.agg(F.countDistinct("k"), F.countDistinct("entity")).first()
    if n * p > DENSE_CELLS:
        raise ValueError(f"{n} x {p} cells are too many for dense estimation")
    wide = returns.select("k", "entity", "ret").toPandas().pivot(index="k", columns="entity", values="ret").sort_index().dropna(how="any")
    return list(wide.columns), wide.to_numpy()


def alpha_max(matrix: DataFrame) -> float:
    return float(matrix.filter("row <> col").agg(F.max(F.abs("value"))).first()[0])


def alpha_grid(most: float, n: int = 30, low: float = 0.01, high: float = 1.05) -> list[float]:
    return geomspace(low * most, high * most, n)


def _components(adjacent: np.ndarray) -> int:
    left, count = set(range(len(adjacent))), 0
    while left:
        todo, count = [left.pop()], count + 1
        while todo:
            new = {int(j) for j in np.flatnonzero(adjacent[todo.pop()])} & left
            left -= new
            todo += new
    return count


def regularization_path(spark: SparkSession, matrix: DataFrame, alphas: list[float]) -> DataFrame:
    """One row per alpha: edges, density, components, isolates, degrees, partial strengths, iterations; one task per fit."""
    cells = matrix.count()
    if cells > DENSE_CELLS:
        raise ValueError(f"{cells} cells are too many for dense estimation")
    _, s = to_dense(matrix.toPandas())

    def fit(batches):
        for batch in batches:
            out = []
            for alpha in batch["alpha"]:
                r = graphical_lasso(s, alpha)
                theta, p = r["precision"], len(s)
                on = np.abs(theta) > SUPPORT
                np.fill_diagonal(on, False)
                strength, degree, m = np.abs(partial_matrix(theta))[np.triu(on)], on.sum(axis=0), int(on.sum()) // 2
                out.append((alpha, m, 2 * m / (p * (p - 1)), _components(on), int((degree == 0).sum()), float(degree.mean()), int(degree.max()), float(strength.mean()) if m else 0.0, float(strength.max()) if m else 0.0, r["n_iter"], r["converged"]))
            yield pd.DataFrame(out, columns=["alpha", "n_edges", "density", "n_components", "n_isolated", "mean_degree", "max_degree", "mean_abs_partial", "max_abs_partial", "n_iter", "converged"])

    grid = spark.createDataFrame([(a,) for a in alphas], "alpha double").repartition(len(alphas))
    return map_batches(grid, fit, "alpha double, n_edges int, density double, n_components int, n_isolated int, mean_degree double, max_degree int, mean_abs_partial double, max_abs_partial double, n_iter int, converged boolean")


def time_folds(n: int, folds: int = 5) -> list[tuple[int, int]]:
    """(train end, test end) of expanding, time-ordered folds with equal tests."""
    size = n // (folds + 1)
    first = n - folds * size
    return [(first + i * size, first + (i + 1) * size) for i in range(folds)]


def cross_validate(spark: SparkSession, returns: DataFrame, alphas: list[float], folds: int = 5) -> DataFrame:
    """(alpha, mean_score, sd_score, selected): Gaussian log-likelihood on time-ordered folds; alpha 0 is added.

    The whole sample is standardised before it is split, as in the workflow that this reproduces.
    """
    _, x = dense_panel(returns)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    grid = [(float(a), i) for a in sorted({0.0, *alphas}) for i in range(folds)]
    cuts = time_folds(len(z), folds)

    def score(batches):
        for batch in batches:
            out = []
            for alpha, i in zip(batch["alpha"], batch["fold"], strict=True):
                train, test = z[: cuts[i][0]], z[cuts[i][0] : cuts[i][1]]
                theta = graphical_lasso(train.T @ train / len(train), alpha)["precision"]
                s, p = test.T @ test / len(test), z.shape[1]
                out.append((alpha, i, float((np.linalg.slogdet(theta)[1] - (s * theta).sum() - p * np.log(2 * np.pi)) / 2)))
            yield pd.DataFrame(out, columns=["alpha", "fold", "score"])

    scores = map_batches(spark.createDataFrame(grid, "alpha double, fold int").repartition(len(grid)), score, "alpha double, fold int, score double")
    by = scores.groupBy("alpha").agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("sd_score"))
    best = by.agg(F.max_by("alpha", F.struct("mean_score", "alpha")).alias("best"))
    return by.join(best).select("alpha", "mean_score", "sd_score", (F.col("alpha") == F.col("best")).alias("selected"))


def one_standard_error(cv: DataFrame, folds: int = 5) -> DataFrame:
    """(alpha_cv, best_score, se, floor, alpha_1se): the largest positive alpha whose mean is within one standard error of the best."""
    best = cv.orderBy(F.desc("mean_score"), "alpha").limit(1).select(F.col("alpha").alias("alpha_cv"), F.col("mean_score").alias("best_score"), (F.col("sd_score") / F.sqrt(F.lit(float(folds)))).alias("se"))
    best = best.withColumn("floor", F.col("best_score") - F.col("se"))
    near = cv.join(best, (F.col("alpha") > 0) & (F.col("mean_score") >= F.col("floor")))
    return near.groupBy("alpha_cv", "best_score", "se", "floor").agg(F.max("alpha").alias("alpha_1se"))


def only_alpha(selection: DataFrame, candidates: tuple[str, ...] = ("alpha_1se", "alpha")) -> float:
    """The single value of the first candidate column that has exactly one."""
    for c in candidates:
        if c in selection.columns:
            values = selection.select(F.col(c).cast("double")).distinct().limit(2).collect()
            if len(values) == 1 and values[0][0] is not None:
                return float(values[0][0])
    raise ValueError(f"no column of {candidates} has a single value")


# --- resampling ----------------------------------------------------------------------------------------------


def block_indices(n: int, target: int, block: int, rng: np.random.Generator) -> list[int]:
    """Moving blocks with uniformly drawn starts, appended until ``target`` and cut there."""
    if not 1 <= block <= n:
        raise ValueError("block length must be between 1 and n")
    out: list[int] = []
    while len(out) < target:
        start = int(rng.integers(0, n - block + 1))
        out += range(start, start + block)
    return out[:target]


def resample_fits(returns: DataFrame, alpha: float, runs: int = 200, block: int = 20, share: float = 0.8, seed: int = 20260814) -> DataFrame:
    """(run, e1, e2, weight, valid, n_iter, reason) of every pair and resample; draws come from one generator on the driver."""
    spark = returns.sparkSession
    names, x = dense_panel(returns)
    rng = np.random.default_rng(seed)
    draws = [(i, block_indices(len(x), int(share * len(x)), block, rng)) for i in range(runs)]
    first, second = np.triu_indices(len(names), 1)

    def fit(batches):
        for batch in batches:
            for run, index in zip(batch["run"], batch["index"], strict=True):
                sample = x[np.asarray(index)]
                sd, reason, weight, n_iter = sample.std(axis=0), None, np.zeros(len(first)), 0
                if (sd < 1e-12).any():
                    reason = "no variation"
                else:
                    z = (sample - sample.mean(axis=0)) / sd
                    r = graphical_lasso(z.T @ z / len(z), alpha)
                    n_iter, theta = r["n_iter"], r["precision"]
                    if r["converged"]:
                        weight = np.where(np.abs(theta[first, second]) > SUPPORT, partial_matrix(theta)[first, second], 0.0)
                    else:
                        reason = "not converged"
                yield pd.DataFrame({"run": run, "e1": [names[i] for i in first], "e2": [names[j] for j in second], "weight": weight, "valid": reason is None, "n_iter": n_iter, "reason": reason})

    frame = spark.createDataFrame(draws, "run int, index array<int>").repartition(min(runs, 200), "run")
    return map_batches(frame, fit, "run int, e1 string, e2 string, weight double, valid boolean, n_iter int, reason string")


def stability(fits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per pair: selected_count, valid_runs, frequency, mean and sd of the weight when selected, signs, class."""
    on = F.col("valid") & (F.col("weight") != 0)
    when = F.when(on, F.col("weight"))
    out = fits.groupBy(*keys, "e1", "e2").agg(
        F.count_if(on).alias("selected_count"), F.count_if("valid").alias("valid_runs"), F.avg(when).alias("mean_when_selected"), F.stddev_pop(when).alias("sd_when_selected"),
        F.count_if(on & (F.col("weight") > 0)).alias("_pos"), F.count_if(on & (F.col("weight") < 0)).alias("_neg"),
    )
    part = lambda c: F.try_divide(F.col(c).cast("double"), F.nullif(F.col("selected_count").cast("double"), F.lit(0.0)))
    out = out.withColumns({"frequency": F.try_divide(F.col("selected_count").cast("double"), F.col("valid_runs").cast("double")), "positive_fraction": part("_pos"), "negative_fraction": part("_neg")})
    return out.withColumns({
        "sign_consistency": F.greatest("positive_fraction", "negative_fraction"),
        "dominant_sign": F.when(F.col("selected_count") == 0, "never_selected").when(F.col("_pos") >= F.col("_neg"), "positive").otherwise("negative"),
        "stability_class": F.when(F.col("frequency") >= 0.9, "core").when(F.col("frequency") >= 0.8, "stable").when(F.col("frequency") >= 0.5, "moderate").otherwise("unstable"),
    }).drop("_pos", "_neg")


def run_summary(fits: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of valid runs, and mean and sd of their edge counts."""
    runs = fits.groupBy(*keys, "run").agg(F.first("valid").alias("valid"), F.count_if(F.col("weight") != 0).alias("n_edges"))
    edges = F.when(F.col("valid"), F.col("n_edges"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("valid").cast("double")).alias("valid_rate"), F.avg(edges).alias("mean_edges"), F.stddev_samp(edges).alias("sd_edges"))


def block_robustness(returns: DataFrame, alpha: float, blocks: tuple[int, ...] = (10, 20, 40), runs: int = 200, seed: int = 20260817) -> DataFrame:
    """resample_fits for each block length, seeded by it."""
    out = None
    for block in blocks:
        fits = resample_fits(returns, alpha, runs, block, seed=seed + block).withColumn("block_length", F.lit(block))
        out = fits if out is None else out.unionByName(fits)
    return out


def set_jaccards(stable: DataFrame, least: float = 0.8) -> DataFrame:
    """Jaccard of the stable edge sets of every two block lengths; null if both are empty."""
    sets = stable.filter(F.col("frequency") >= least).select("block_length", "e1", "e2")
    sizes = stable.groupBy("block_length").agg(F.count_if(F.col("frequency") >= least).alias("n"))
    pair = sizes.select(F.col("block_length").alias("a"), F.col("n").alias("n_a")).join(sizes.select(F.col("block_length").alias("b"), F.col("n").alias("n_b")), F.col("a") < F.col("b"))
    common = sets.select(F.col("block_length").alias("a"), "e1", "e2").join(sets.select(F.col("block_length").alias("b"), "e1", "e2"), ["e1", "e2"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    out = pair.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.withColumn("jaccard", F.try_divide(F.col("common").cast("double"), F.nullif((F.col("n_a") + F.col("n_b") - F.col("common")).cast("double"), F.lit(0.0))))


def baseline_retention(stable: DataFrame, baseline: DataFrame, least: float = 0.8, core: float = 0.9) -> DataFrame:
    """By block length: stable and core pairs, and how many of the baseline's edges are stable, as a number and a share."""
    known = stable.join(baseline.select("e1", "e2", F.lit(True).alias("_base")).distinct(), ["e1", "e2"], "left")
    on = F.col("frequency") >= least
    out = known.groupBy("block_length").agg(F.count_if(on).alias("n_stable"), F.count_if(F.col("frequency") >= core).alias("n_core"), F.count_if(on & F.col("_base")).alias("n_retained"))
    total = baseline.select("e1", "e2").distinct().agg(F.count(F.lit(1)).alias("n_baseline"))
    return out.join(total).withColumn("retention", ratio("n_retained", "n_baseline"))


def robust_edges(stable: DataFrame, blocks: tuple[int, ...] = (10, 20, 40)) -> DataFrame:
    """One row per pair: the frequency by block length, least, mean, largest, range, and whether stable or core at all."""
    wide = stable.groupBy("e1", "e2").pivot("block_length", list(blocks)).agg(F.first("frequency"))
    names = [f"frequency_{b}" for b in blocks]
    wide = wide.select("e1", "e2", *[F.col(str(b)).alias(n) for b, n in zip(blocks, names, strict=True)])
    low, high = F.least(*names), F.greatest(*names)
    return wide.withColumns({"min_frequency": low, "mean_frequency": sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names), "max_frequency": high, "frequency_range": high - low, "stable_all": low >= 0.8, "core_all": low >= 0.9})


# --- rolling -------------------------------------------------------------------------------------------------


def windows(returns: DataFrame, size: int, step: int) -> DataFrame:
    """(window_id, k, window_start, window_end): the rows of each count-based window over the dates."""
    dates = returns.select("k", "t").distinct().withColumn("i", F.row_number().over(W.orderBy("k")) - 1)
    n = F.count(F.lit(1)).over(W.partitionBy())
    last = F.least(F.floor(F.col("i") / step), F.floor((n - size) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step))
    rows = dates.withColumn("_w", F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>")))
    rows = rows.select("k", "t", F.explode("_w").alias("window_id")).withColumn("window_id", F.col("window_id") + 1)
    w = W.partitionBy("window_id")
    return rows.select("window_id", "k", F.min("t").over(w).alias("window_start"), F.max("t").over(w).alias("window_end"))


HISTORY = "window_id int, window_start date, network_date date, e1 string, e2 string, precision double, weight double, selected boolean, converged boolean, n_iter int, dual_gap double"


def _fit_window(group: pd.DataFrame, alpha: float, keys: list[str]) -> pd.DataFrame:
    """All pairs of one window; dates at which an entity is missing are left out."""
    wide = group.pivot(index="k", columns="entity", values="ret").sort_index().dropna(how="any")
    names, x = list(wide.columns), wide.to_numpy()
    sd = x.std(axis=0)
    if (sd <= 1e-12).any():
        raise ValueError(f"window {group['window_id'].iloc[0]}: an entity doesn't vary")
    z = (x - x.mean(axis=0)) / sd
    r = graphical_lasso(z.T @ z / len(z), alpha)
    i, j = np.triu_indices(len(names), 1)
    theta = r["precision"][i, j]
    on = np.abs(theta) > SUPPORT
    out = {k: group[k].iloc[0] for k in keys} | {"window_id": group["window_id"].iloc[0], "window_start": group["window_start"].iloc[0], "network_date": group["window_end"].iloc[0]}
    out |= {"e1": [names[a] for a in i], "e2": [names[b] for b in j], "precision": theta, "weight": np.where(on, partial_matrix(r["precision"])[i, j], 0.0), "selected": on}
    return pd.DataFrame(out | {"converged": r["converged"], "n_iter": r["n_iter"], "dual_gap": r["dual_gap"]})


def rolling_glasso(returns: DataFrame, alpha: float, size: int = 252, step: int = 20) -> DataFrame:
    """The edge history: every pair in every window, with precision, weight, selected; one task per window's fit."""
    rows = returns.select("k", "entity", "ret").join(windows(returns, size, step), "k")
    return apply_groups(rows, ["window_id"], lambda g: _fit_window(g, alpha, []), HISTORY)


def window_sizes(returns: DataFrame, alpha: float, sizes: tuple[int, ...] = (126, 252, 504), anchor: int = 252, step: int = 20) -> DataFrame:
    """Edge histories of several window sizes on their common end dates; window_id is the anchor size's."""
    n = returns.agg(F.countDistinct("k")).first()[0]
    ends = [(size, window, end - size + 1, end) for end, window in common_ends(n, sizes, anchor, step) for size in sizes]
    spans = returns.sparkSession.createDataFrame(ends, "window_size int, window_id int, first int, last int")  # a row per window and size
    dates = returns.select("k", "t").distinct().withColumn("i", F.row_number().over(W.orderBy("k")) - 1)
    w = W.partitionBy("window_size", "window_id")
    inside = dates.join(F.broadcast(spans), (F.col("i") >= F.col("first")) & (F.col("i") <= F.col("last"))).select("window_size", "window_id", "k", F.min("t").over(w).alias("window_start"), F.max("t").over(w).alias("window_end"))
    rows = returns.select("k", "entity", "ret").join(inside, "k")
    return apply_groups(rows, ["window_size", "window_id"], lambda g: _fit_window(g, alpha, ["window_size"]), "window_size int, " + HISTORY)


def common_ends(n: int, sizes: tuple[int, ...] = (126, 252, 504), anchor: int = 252, step: int = 20) -> list[tuple[int, int]]:
    """(end row, window id of the anchor size) of the end rows that every window size can reach."""
    return [(end, (end - anchor + 1) // step + 1) for end in range(anchor - 1, n, step) if end >= max(sizes) - 1]


