"""Comparison of edge sets, pair tables and node tables of two or three networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import median, ratio, safe_corr
from .dependence import matrix_of

PEARSON_STRONG, PARTIAL_STRONG, NEAR_ZERO, MEANINGFUL = 0.5, 0.2, 0.05, 0.05
#: Names of the relations between a pair's Pearson and partial correlation.
RELATIONS = {
    "vanished": "Pearson强相关基本消失",
    "reversed": "条件关系符号反转",
    "kept": "强相关仍部分保留",
    "weakened": "强相关明显减弱",
    "strengthened": "控制后关联增强",
    "other": "其他",
}


def _keys(edges: DataFrame) -> DataFrame:
    return edges.select("e1", "e2").distinct()


def edge_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _keys(a).intersect(_keys(b))


def edge_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _keys(a).union(_keys(b)).distinct()


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _keys(a).join(_keys(b), ["e1", "e2"], "left_anti")


def edge_status(a: DataFrame, b: DataFrame, name_a: str, name_b: str) -> DataFrame:
    """(e1, e2, weight_a, weight_b, status) over the union of both edge sets."""
    left = a.select("e1", "e2", F.col("weight").alias("weight_a"), F.lit(True).alias("in_a"))
    right = b.select("e1", "e2", F.col("weight").alias("weight_b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a") & F.col("in_b"), "Both").when(F.col("in_a"), f"{name_a} only").otherwise(f"{name_b} only")
    return left.join(right, ["e1", "e2"], "full").select("e1", "e2", "weight_a", "weight_b", status.alias("status"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes, common, only, union, Jaccard, share of a kept in b and of b found in a; null on an empty denominator."""
    both = edge_status(a, b, "a", "b")
    out = both.agg(F.count_if(F.col("weight_a").isNotNull()).alias("edges_a"), F.count_if(F.col("weight_b").isNotNull()).alias("edges_b"), F.count_if(F.col("status") == "Both").alias("common"), F.count(F.lit(1)).alias("union_edges"))
    return out.select("edges_a", "edges_b", "common", (F.col("edges_a") - F.col("common")).alias("a_only"), (F.col("edges_b") - F.col("common")).alias("b_only"), "union_edges", ratio("common", "union_edges").alias("jaccard"), ratio("common", "edges_a").alias("a_retention"), ratio("common", "edges_b").alias("b_support"))


def pair_comparison(pairs: DataFrame) -> DataFrame:
    """(e1, e2, pearson, partial) with changes, attenuation, retention, sign flips and the relation's name."""
    rho, pi = F.col("pearson"), F.col("partial")
    a, b = F.abs(rho), F.abs(pi)
    flip = F.signum(rho) * F.signum(pi) < 0
    big_flip = flip & (a >= MEANINGFUL) & (b >= MEANINGFUL)
    strong = a >= PEARSON_STRONG
    relation = (
        F.when(strong & (b <= NEAR_ZERO), RELATIONS["vanished"]).when(big_flip, RELATIONS["reversed"]).when(strong & (b >= PARTIAL_STRONG), RELATIONS["kept"])
        .when(strong, RELATIONS["weakened"]).when(b > a, RELATIONS["strengthened"]).otherwise(RELATIONS["other"])
    )
    return pairs.select(
        "e1", "e2", "pearson", "partial", a.alias("abs_pearson"), b.alias("abs_partial"), (pi - rho).alias("signed_change"), (a - b).alias("attenuation"),
        F.when(a > 1e-12, b / a).alias("retention_ratio"), flip.alias("sign_flip"), big_flip.alias("meaningful_sign_flip"), relation.alias("relation_type"),
    )


def attenuation_matrix(compared: DataFrame) -> DataFrame:
    """(row, col, value): |Pearson| - |partial| of every pair, both ways, 0 on the diagonal."""
    return matrix_of(compared, "attenuation", 0.0)


def comparison_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("pearson").alias("mean_pearson"), F.avg("partial").alias("mean_partial"), F.avg("abs_pearson").alias("mean_abs_pearson"), F.avg("abs_partial").alias("mean_abs_partial"),
        median("abs_pearson").alias("median_abs_pearson"), median("abs_partial").alias("median_abs_partial"), F.count_if(F.col("abs_pearson") >= PEARSON_STRONG).alias("n_pearson_strong"),
        F.count_if(F.col("abs_partial") >= PARTIAL_STRONG).alias("n_partial_strong"), F.count_if(F.col("attenuation") > 0).alias("n_weakened"), F.count_if("sign_flip").alias("n_sign_flip"),
        F.count_if("meaningful_sign_flip").alias("n_meaningful_sign_flip"), safe_corr("pearson", "partial").alias("pearson_partial_corr"),
    )


def node_comparison(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b", measures: tuple[str, ...] = ("degree", "strength", "betweenness", "closeness")) -> DataFrame:
    """Both networks' measures by entity, and b - a."""
    left = a.select("entity", *[F.col(m).alias(f"{name_a}_{m}") for m in measures])
    right = b.select("entity", *[F.col(m).alias(f"{name_b}_{m}") for m in measures])
    out = left.join(right, "entity", "full")
    return out.select("*", *[(F.col(f"{name_b}_{m}") - F.col(f"{name_a}_{m}")).alias(f"{m}_change") for m in measures])


def three_methods(spine: DataFrame, partial: DataFrame, cv: DataFrame, one_se: DataFrame) -> DataFrame:
    """All pairs with three weights, membership flags, the main edge type, sign agreement and shrinkage.

    spine: (e1, e2, partial); the other three are edge lists (e1, e2, weight).
    """
    flagged = spine
    for name, edges in (("partial", partial), ("cv", cv), ("1se", one_se)):
        flagged = flagged.join(edges.select("e1", "e2", F.col("weight").alias(f"w_{name}"), F.lit(True).alias(f"in_{name}")), ["e1", "e2"], "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    kind = F.when(F.col("in_partial") & F.col("in_1se"), "Common").when(F.col("in_partial"), "Partial-only").when(F.col("in_1se"), "GLasso-1SE-only").otherwise("Neither")
    same = F.when(F.col("in_partial") & F.col("in_1se"), F.signum("w_partial") == F.signum("w_1se"))
    return flagged.select("e1", "e2", "partial", "w_cv", "w_1se", "in_partial", "in_cv", "in_1se", kind.alias("main_edge_type"), same.alias("sign_same"), (F.abs("partial") - F.abs(F.coalesce("w_1se", F.lit(0.0)))).alias("abs_shrinkage"))


def common_strong(compared: DataFrame) -> DataFrame:
    """(n_common, sign_agreement) of the pairs that both the thresholded partial and the 1SE network have."""
    return compared.filter("in_partial AND in_1se").agg(F.count(F.lit(1)).alias("n_common"), F.avg(F.col("sign_same").cast("double")).alias("sign_agreement"))
