"""Validation of keys, pairs and matrices: each check counts violating rows and raises on any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _none(df: DataFrame, message: str) -> None:
    bad = df.limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    _none(df.groupBy(*keys).count().filter("count > 1"), f"duplicate {keys}")


def require_no_nulls(df: DataFrame, names: list[str]) -> None:
    _none(df.filter(" OR ".join(f"`{c}` IS NULL" for c in names)), f"nulls in {names}")


def require_consistent(df: DataFrame, key: str, attributes: list[str]) -> None:
    """One value of each attribute for each key."""
    counts = df.groupBy(key).agg(*[F.countDistinct(c).alias(c) for c in attributes])
    _none(counts.filter(" OR ".join(f"`{c}` > 1" for c in attributes)), f"conflicting attributes of {key}")


def require_complete_pairs(history: DataFrame, window: str = "window_id") -> None:
    """Every window has all p(p-1)/2 pairs of its entities."""
    nodes = history.select(window, F.explode(F.array("e1", "e2")).alias("e")).groupBy(window).agg(F.countDistinct("e").alias("p"))
    pairs = history.groupBy(window).agg(F.countDistinct("e1", "e2").alias("m"), F.count(F.lit(1)).alias("n"))
    _none(nodes.join(pairs, window).filter("m <> p * (p - 1) / 2 OR n <> m"), "incomplete pairs")


def require_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    left, right = a.select(*keys), b.select(*keys)
    _none(left.exceptAll(right).unionByName(right.exceptAll(left)), f"{keys} differ")


def require_square(matrix: DataFrame, tolerance: float = 1e-10) -> None:
    """Long matrix (row, col, value): the same keys on both sides, every cell once, symmetric, positive diagonal."""
    require_unique(matrix, ["row", "col"])
    rows, cols, n = matrix.agg(F.countDistinct("row"), F.countDistinct("col"), F.count(F.lit(1))).first()
    if rows != cols or n != rows * cols:
        raise ValueError(f"not square: {rows} rows, {cols} columns, {n} cells")
    flip = matrix.select(F.col("row").alias("col"), F.col("col").alias("row"), F.col("value").alias("other"))
    _none(matrix.join(flip, ["row", "col"], "left").filter(F.col("other").isNull() | (F.abs(F.col("value") - F.col("other")) > tolerance)), "not symmetric")
    _none(matrix.filter("row = col AND NOT coalesce(value > 0, false)"), "diagonal not positive")
