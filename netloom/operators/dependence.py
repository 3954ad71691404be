"""From a panel to dependence: returns, correlation, covariance, precision and partial correlation.

Panels are long (t, k, entity, value); pair frames are (e1, e2, ...) with
e1 < e2; matrices are (row, col, value).  Everything but the dense inverse is
relational: pair moments come from one self-join on the date with partial
aggregation, which holds to about a thousand entities; the inverse runs in one
grouped function on an array of p*p numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import EPS, safe_corr
from ..shipping import apply_groups

TRADING_DAYS = 252
MIN_PERIODS = 120


def log_returns(spine: DataFrame) -> DataFrame:
    """(t, k, entity, ret): ln p(t) - ln p(t-1) on the spine's dates, nothing filled; dates without any return go."""
    log = F.when(F.col("value") > 0, F.log("value"))
    w = W.partitionBy("entity").orderBy("k")
    out = spine.withColumn("ret", log - F.lag(log).over(w)).select("t", "k", "entity", "ret")
    dated = out.groupBy("k").agg(F.count("ret").alias("n")).filter("n > 0").select("k")
    return out.join(dated, "k", "left_semi")


def return_summary(returns: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    return returns.groupBy("entity").agg(
        F.count("ret").alias("n_obs"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd_ret"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"), F.min("ret").alias("min_ret"), F.max("ret").alias("max_ret"),
    )


def _pairs(returns: DataFrame) -> DataFrame:
    known = returns.filter("ret IS NOT NULL").select("k", "entity", "ret")
    a = known.select("k", F.col("entity").alias("e1"), F.col("ret").alias("x"))
    b = known.select("k", F.col("entity").alias("e2"), F.col("ret").alias("y"))
    return a.join(b, "k").filter("e1 < e2")


def joint_counts(returns: DataFrame) -> DataFrame:
    """(e1, e2, n_common) of all ordered pairs and the diagonal; pairs never seen together have 0."""
    known = returns.filter("ret IS NOT NULL")
    a, b = known.select("k", F.col("entity").alias("e1")), known.select("k", F.col("entity").alias("e2"))
    counts = a.join(b, "k").groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_common"))
    names = returns.select("entity").distinct()
    grid = names.select(F.col("entity").alias("e1")).join(names.select(F.col("entity").alias("e2")))
    return grid.join(counts, ["e1", "e2"], "left").select("e1", "e2", F.coalesce("n_common", F.lit(0)).alias("n_common"))


def pearson(returns: DataFrame, min_periods: int = MIN_PERIODS) -> DataFrame:
    """(e1, e2, corr, n_common), pairwise-complete; null below min_periods common dates."""
    out = _pairs(returns).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_common"), safe_corr("x", "y").alias("corr"))
    return out.select("e1", "e2", F.when(F.col("n_common") >= min_periods, F.col("corr")).alias("corr"), "n_common")


def complete_rows(returns: DataFrame) -> DataFrame:
    """Only the dates at which every entity has a return."""
    p = returns.agg(F.countDistinct("entity").alias("p"))
    full = returns.groupBy("k").agg(F.count("ret").alias("n")).join(p, F.col("n") == F.col("p")).select("k")
    return returns.join(full, "k", "left_semi")


def covariance(returns: DataFrame) -> DataFrame:
    """(row, col, value), listwise-complete, divided by n - 1."""
    full = complete_rows(returns).select("k", "entity", "ret")
    a = full.select("k", F.col("entity").alias("row"), F.col("ret").alias("x"))
    b = full.select("k", F.col("entity").alias("col"), F.col("ret").alias("y"))
    return a.join(b, "k").groupBy("row", "col").agg(F.covar_samp("x", "y").alias("value"))


def _with_diagonal(matrix: DataFrame) -> DataFrame:
    diagonal = matrix.filter("row = col")
    return matrix.join(diagonal.select("row", F.col("value").alias("d1")), "row").join(diagonal.select("col", F.col("value").alias("d2")), "col")


def correlation_of(cov: DataFrame) -> DataFrame:
    """sigma_ij / (sigma_i sigma_j)."""
    return _with_diagonal(cov).select("row", "col", F.when(F.col("row") == F.col("col"), 1.0).otherwise(F.col("value") / F.sqrt(F.col("d1") * F.col("d2"))).alias("value"))


def correlation_agreement(returns: DataFrame) -> DataFrame:
    """(n_cells, max_direct, max_matrix, agree): how far apart the correlations of complete rows are, taken directly, from the covariances and as D^-1/2 S D^-1/2."""
    cov = covariance(returns)
    full = complete_rows(returns)
    a, b = full.select("k", F.col("entity").alias("row"), F.col("ret").alias("x")), full.select("k", F.col("entity").alias("col"), F.col("ret").alias("y"))
    direct = a.join(b, "k").groupBy("row", "col").agg(safe_corr("x", "y").alias("direct"))
    scaled = _with_diagonal(cov).select("row", "col", (1 / F.sqrt("d1") * F.col("value") * (1 / F.sqrt("d2"))).alias("matrix"))
    cells = correlation_of(cov).join(direct, ["row", "col"]).join(scaled, ["row", "col"])
    out = cells.agg(F.count(F.lit(1)).alias("n_cells"), F.max(F.abs(F.col("value") - F.col("direct"))).alias("max_direct"), F.max(F.abs(F.col("value") - F.col("matrix"))).alias("max_matrix"))
    return out.withColumn("agree", F.greatest("max_direct", "max_matrix") <= 1e-12)


def describe(values: DataFrame, name: str) -> DataFrame:
    """(statistic, value) of a column: count, mean, sample sd, least, quartiles by linear interpolation, largest."""
    known = values.filter(F.col(name).isNotNull()).select(F.col(name).cast("double").alias("x"))
    row = known.agg(F.count("x").cast("double").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), *[F.percentile("x", F.lit(p / 100)).alias(f"{p}%") for p in (25, 50, 75)], F.max("x").alias("max"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(f"`{c}`").alias("value")) for c in row.columns])))


def partial_of(precision: DataFrame) -> DataFrame:
    """-omega_ij / sqrt(omega_ii omega_jj), 1 on the diagonal; a diagonal that isn't positive raises."""
    guarded = F.when((F.col("d1") > 0) & (F.col("d2") > 0), -F.col("value") / F.sqrt(F.col("d1") * F.col("d2"))).otherwise(F.raise_error(F.lit("diagonal of a precision matrix must be positive")).cast("double"))
    return _with_diagonal(precision).select("row", "col", F.when(F.col("row") == F.col("col"), 1.0).otherwise(guarded).alias("value"))


def pairs_of(matrix: DataFrame, name: str = "weight") -> DataFrame:
    """Upper triangle as (e1, e2, name)."""
    return matrix.filter("row < col").select(F.col("row").alias("e1"), F.col("col").alias("e2"), F.col("value").alias(name))


def matrix_of(pairs: DataFrame, name: str, diagonal: float = 1.0) -> DataFrame:
    """The symmetric matrix of a pair frame."""
    up = pairs.select(F.col("e1").alias("row"), F.col("e2").alias("col"), F.col(name).alias("value"))
    down = up.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    nodes = pairs.select(F.explode(F.array("e1", "e2")).alias("row")).distinct()
    return up.unionByName(down).unionByName(nodes.select("row", F.col("row").alias("col"), F.lit(diagonal).alias("value")))


def standardize(returns: DataFrame) -> DataFrame:
    """(x - mean) / population sd by entity; an entity that doesn't vary raises."""
    w = W.partitionBy("entity")
    sd = F.stddev_pop("ret").over(w)
    z = F.when(sd > EPS, (F.col("ret") - F.avg("ret").over(w)) / sd).otherwise(F.raise_error(F.concat(F.lit("no variation in "), F.col("entity"))).cast("double"))
    return returns.withColumn("z", z)


# --- dense matrices ------------------------------------------------------------------------------------------


def to_dense(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(rows["row"]) | set(rows["col"]))
    at = {e: i for i, e in enumerate(names)}
    m = np.full((len(names), len(names)), np.nan)
    m[rows["row"].map(at).to_numpy(), rows["col"].map(at).to_numpy()] = rows["value"].to_numpy()
    if np.isnan(m).any():
        raise ValueError("matrix has missing cells")
    return names, m


def to_long(names: list[str], m: np.ndarray) -> pd.DataFrame:
    p = len(names)
    return pd.DataFrame({"row": np.repeat(names, p), "col": np.tile(names, p), "value": m.ravel()})


def matrix_diagnostics(matrix: DataFrame) -> DataFrame:
    """size, rank, least and largest eigenvalue, condition number, asymmetry."""

    def diagnose(rows: pd.DataFrame) -> pd.DataFrame:
        _, m = to_dense(rows)
        eigen = np.linalg.eigvalsh((m + m.T) / 2)
        return pd.DataFrame({"size": [len(m)], "rank": [int(np.linalg.matrix_rank(m))], "min_eigen": [eigen[0]], "max_eigen": [eigen[-1]], "condition": [np.linalg.cond(m)], "asymmetry": [np.abs(m - m.T).max()]})

    return apply_groups(matrix, [], diagnose, "size int, rank int, min_eigen double, max_eigen double, condition double, asymmetry double")


def precision(cov: DataFrame) -> DataFrame:
    """(row, col, value, inverse_error) of the inverse; a rank-deficient matrix raises."""

    def invert(rows: pd.DataFrame) -> pd.DataFrame:
        names, m = to_dense(rows)
        if np.linalg.matrix_rank(m) < len(m):
            raise ValueError("covariance is rank-deficient")
        inverse = np.linalg.inv(m)
        return to_long(names, inverse).assign(inverse_error=float(np.abs(m @ inverse - np.eye(len(m))).max()))

    return apply_groups(cov, [], invert, "row string, col string, value double, inverse_error double")
