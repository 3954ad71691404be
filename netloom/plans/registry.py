"""Registered queries of the network-analytics operators and their DuckDB SQL.

Shared panels: monthly brand revenue (returns, 24-month windows every 3
months), daily event values, and embeddings.  Results are rounded to 6 digits
in both engines, as sums may be added in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import compare as C
from ..operators import dependence as D
from ..operators import dynamics as N
from ..operators import graph as G
from ..operators import sparse as S
from ..sources import tables as src
from . import oracle, oracle_more

THRESHOLD, ROLL_SIZE, ROLL_STEP, TOP, MIN_PERIODS = 0.2, 24, 3, 8, 12
SCALES = (18, 24, 36)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    """Register a query; its numbers are rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.round(F.col(c.name), 6).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema])

    run.__doc__ = f.__doc__
    _QUERIES[f.__name__] = run
    return f


# --- inputs ------------------------------------------------------------------------------------------------------


def spine(spark, d):
    return src.on_spine(src.brand_panel(spark, d))


def kept(df):
    """df behind a reliable checkpoint: the panel (months x brands) and the state table (a row per window) are small and read often."""
    return G.settled(df)


def returns(spark, d):
    return kept(D.log_returns(spine(spark, d)))


def dim(spark, d):
    return src.brand_groups(src.brand_panel(spark, d))


def pairs(spark, d):
    return D.pearson(returns(spark, d), MIN_PERIODS).select("e1", "e2", F.col("corr").alias("weight")).filter("weight IS NOT NULL")


def edges(spark, d):
    return G.threshold_edges(pairs(spark, d), THRESHOLD)


def history(spark, d, size=ROLL_SIZE):
    r = returns(spark, d)
    return N.rolling_pearson(r, src.brand_groups(r), size, ROLL_STEP)


def scales(spark, d):
    """Histories of all window sizes on the end dates that the largest can reach."""
    out, r = None, returns(spark, d)
    for size in SCALES:
        h = N.rolling_pearson(r, src.brand_groups(r), size, ROLL_STEP).withColumn("window_size", F.lit(size))
        # a window of size W and id w ends at row W - 1 + (w - 1) * step
        end = size - 1 + (F.col("window_id") - 1) * ROLL_STEP
        h = h.withColumn("window_id", end).filter(F.col("window_id") >= max(SCALES) - 1)
        out = h if out is None else out.unionByName(h)
    return out


def static_edges(spark, d):
    return pairs(spark, d).select("e1", "e2", (F.abs("weight") >= THRESHOLD).alias("static_stable"))


# --- sources, checks, returns, correlation -------------------------------------------------------------------------


@query
def pf8_quality_profile(s, d):
    """Observations, dates, gaps and coverage by brand."""
    return src.coverage_profile(spine(s, d))


@query
def pf7_coverage_filter(s, d):
    return src.covered(spine(s, d), 0.95).select("t", "entity", "value")


@query
def src2_last_per_date(s, d):
    """The last order of each priority and day, by key."""
    bars = src.table(s, d, "orders").select(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("t"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return src.last_per_date(bars, "seq")


@query
def src_event_panel(s, d):
    return src.event_panel(s, d)


@query
def e1_log_returns(s, d):
    return returns(s, d).select("t", "entity", "ret")


@query
def e2_return_summary(s, d):
    return D.return_summary(returns(s, d), 12)


@query
def e3_joint_counts(s, d):
    return D.joint_counts(returns(s, d))


@query
def e4_pearson(s, d):
    return D.pearson(returns(s, d), MIN_PERIODS)


@query
def e5_covariance(s, d):
    """Listwise-complete covariance of the brands' returns."""
    return D.covariance(returns(s, d))


@query
def e6_correlation(s, d):
    return D.correlation_of(D.covariance(returns(s, d)))


@query
def e10_standardize(s, d):
    return D.standardize(returns(s, d).filter("ret IS NOT NULL")).select("t", "entity", "z")


@query
def pf5_complete_rows(s, d):
    return D.complete_rows(returns(s, d)).select("t", "entity", "ret")


# --- graphs --------------------------------------------------------------------------------------------------------


@query
def g1_threshold_edges(s, d):
    return edges(s, d)


@query
def g2_threshold_sensitivity(s, d):
    return G.threshold_sensitivity(pairs(s, d), [0.05, 0.1, 0.2, 0.3, 0.4])


@query
def g2_absolute_sensitivity(s, d):
    return G.threshold_sensitivity(pairs(s, d), [0.05, 0.1, 0.2, 0.3, 0.4], absolute=True)


@query
def g3_distance_graph(s, d):
    return G.distance_graph(pairs(s, d))


@query
def g4_spanning_tree(s, d):
    return G.spanning_tree(pairs(s, d))


@query
def g5_node_degrees(s, d):
    return G.node_degrees(dim(s, d), edges(s, d))


@query
def g8_path_centrality(s, d):
    return G.path_centrality(dim(s, d), edges(s, d))


@query
def g8_hop_centrality(s, d):
    return G.path_centrality(dim(s, d), edges(s, d), weighted=False)


@query
def g10_components(s, d):
    return G.components(dim(s, d), edges(s, d))


@query
def g14_network_summary(s, d):
    nodes, links = kept(dim(s, d)), kept(edges(s, d))
    return G.network_summary(nodes, links, nodes)


@query
def g16_assortativity(s, d):
    return G.assortativity(edges(s, d), dim(s, d))


@query
def g17_edge_groups(s, d):
    return G.enrich(edges(s, d), dim(s, d))


@query
def g19_union_graph(s, d):
    return G.union_graph(history(s, d))


@query
def g20_common_graph(s, d):
    return G.common_graph(history(s, d), [1, 2, 3])


@query
def t1_tree_length(s, d):
    return G.tree_length(G.spanning_tree(pairs(s, d)))


def window_trees(s, d):
    return kept(G.spanning_trees(kept(history(s, d))))


@query
def t3_window_trees(s, d):
    return window_trees(s, d)


@query
def t3_tree_survival(s, d):
    return G.tree_survival(window_trees(s, d))


@query
def a13_describe(s, d):
    """What describe() says of the pairs' correlations."""
    return D.describe(pairs(s, d), "weight")


@query
def e6_agreement(s, d):
    return D.correlation_agreement(returns(s, d))


@query
def l3_top_pairs(s, d):
    """The 30 strongest pairs, in order."""
    return pairs(s, d).orderBy(F.round("weight", 9).desc(), "e1", "e2").limit(30)


@query
def snk3_tree_layout(s, d):
    return G.tree_layout(G.spanning_tree(pairs(s, d)))


# --- precision and sparse precision --------------------------------------------------------------------------------


def event_cov(s, d):
    return D.covariance(D.log_returns(src.on_spine(src.event_panel(s, d))))


@query
def e7_matrix_diagnostics(s, d):
    return D.matrix_diagnostics(event_cov(s, d))


@query
def e8_precision(s, d):
    return D.precision(event_cov(s, d))


@query
def e9_partial(s, d):
    return D.partial_of(D.precision(event_cov(s, d)).drop("inverse_error"))


@query
def e11_graphical_lasso(s, d):
    return S.support(S.glasso(D.matrix_of(pairs(s, d), "weight"), 0.15)).select("e1", "e2", "precision", "weight")


@query
def e12_regularization_path(s, d):
    matrix = D.matrix_of(pairs(s, d), "weight")
    return S.regularization_path(s, matrix, S.alpha_grid(S.alpha_max(matrix)))


def daily_returns(s, d):
    return D.log_returns(src.on_spine(src.event_panel(s, d)))


def cv_scores(s, r):
    return S.cross_validate(s, r, S.alpha_grid(S.alpha_max(D.correlation_of(D.covariance(r)))))


@query
def e14_cross_validation(s, d):
    return cv_scores(s, kept(daily_returns(s, d)))


@query
def e15_one_standard_error(s, d):
    return S.one_standard_error(cv_scores(s, kept(daily_returns(s, d))))


BLOCKS = (3, 5, 8)


def selected(s, d):
    """The returns, and the alpha that the one-standard-error rule selects (or one tenth, if it selects none)."""
    r = kept(daily_returns(s, d))
    chosen = kept(S.one_standard_error(cv_scores(s, r)))
    return r, 0.1 if chosen.isEmpty() else S.only_alpha(chosen)


def block_fits(s, d):
    return S.block_robustness(*selected(s, d), BLOCKS)


@query
def e17_resample_stability(s, d):
    return S.stability(S.resample_fits(*selected(s, d), block=5))


@query
def e19_block_robustness(s, d):
    return S.stability(block_fits(s, d), ("block_length",))


@query
def e19_run_summary(s, d):
    return S.run_summary(block_fits(s, d), ("block_length",))


@query
def e20_block_jaccards(s, d):
    return S.set_jaccards(S.stability(block_fits(s, d), ("block_length",)))


@query
def e21_robust_edges(s, d):
    return S.robust_edges(S.stability(block_fits(s, d), ("block_length",)), BLOCKS)


# the same counting over fits that SQL can make: every window of a size is a run, and the sizes stand for block lengths


def window_fits(s, d):
    on = F.when(F.col("selected"), F.col("weight")).otherwise(0.0)
    return scales(s, d).select(F.col("window_id").alias("run"), "e1", "e2", on.alias("weight"), F.col("weight").isNotNull().alias("valid"), F.col("window_size").alias("block_length"))


def window_stability(s, d):
    return S.stability(window_fits(s, d), ("block_length",))


@query
def e18_window_stability(s, d):
    return window_stability(s, d)


@query
def e18_window_runs(s, d):
    return S.run_summary(window_fits(s, d), ("block_length",))


@query
def e20_window_jaccards(s, d):
    return S.set_jaccards(kept(window_stability(s, d)), 0.5)


@query
def e21_robust_window_edges(s, d):
    return S.robust_edges(window_stability(s, d), SCALES)


@query
def e19_baseline_retention(s, d):
    return S.baseline_retention(window_stability(s, d), edges(s, d), 0.5)


@query
def e15_rule_on_a_table(s, d):
    """The rule over a table of scores: prices by discount stand for scores by alpha."""
    price = F.col("l_extendedprice").cast("double") / 1000
    cv = src.table(s, d, "lineitem").groupBy(F.col("l_discount").cast("double").alias("alpha")).agg(F.avg(price).alias("mean_score"), (F.stddev_pop(price) / 50).alias("sd_score"))
    return S.one_standard_error(cv)


@query
def e22_rolling_glasso(s, d):
    return S.rolling_glasso(daily_returns(s, d), 0.1, 15, 5)


@query
def e23_window_sizes(s, d):
    """Sparse networks of three window sizes on their common end dates."""
    return S.window_sizes(daily_returns(s, d), 0.1, (10, 15, 20), 15, 3)


@query
def t2_occupation_layer(s, d):
    return G.occupation_layer(G.spanning_tree(pairs(s, d)))


# --- comparison ------------------------------------------------------------------------------------------------------


def halves(s, d):
    """Edges of the first and the last window."""
    h = history(s, d).filter("selected")
    last = h.agg(F.max("window_id").alias("last"))
    return h.filter("window_id = 1").select("e1", "e2", "weight"), h.join(last, F.col("window_id") == F.col("last")).select("e1", "e2", "weight")


@query
def set1_intersection(s, d):
    return C.edge_intersection(*halves(s, d))


@query
def set2_union(s, d):
    return C.edge_union(*halves(s, d))


@query
def set3_difference(s, d):
    return C.edge_difference(*halves(s, d))


@query
def set4_overlap(s, d):
    return C.overlap(*halves(s, d))


@query
def set5_edge_status(s, d):
    return C.edge_status(*halves(s, d), "First", "Last")


def two_weights(s, d):
    """Full-sample correlation against the last window's, pair by pair."""
    h = history(s, d)
    last = h.join(h.agg(F.max("window_id").alias("last")), F.col("window_id") == F.col("last"))
    return pairs(s, d).select("e1", "e2", F.col("weight").alias("pearson")).join(last.select("e1", "e2", F.col("weight").alias("partial")).filter("partial IS NOT NULL"), ["e1", "e2"])


@query
def c1_pair_comparison(s, d):
    return C.pair_comparison(two_weights(s, d))


@query
def c2_comparison_summary(s, d):
    return C.comparison_summary(C.pair_comparison(two_weights(s, d)))


@query
def c4_node_comparison(s, d):
    a, b = halves(s, d)
    nodes = kept(dim(s, d))
    return C.node_comparison(G.node_degrees(nodes, a), G.node_degrees(nodes, b), "first", "last", ("degree", "strength"))


@query
def c3_attenuation_matrix(s, d):
    return C.attenuation_matrix(C.pair_comparison(two_weights(s, d)))


@query
def c4_node_paths(s, d):
    """Betweenness and closeness of the first and the last window's networks, by distance."""
    a, b = halves(s, d)
    nodes = kept(dim(s, d))
    far = lambda e: G.path_centrality(nodes, kept(e.withColumn("distance", G.distance())))
    return C.node_comparison(far(a), far(b), "first", "last", ("betweenness", "closeness"))


def methods(s, d):
    """All pairs with three networks: thresholded full-sample correlation, the first window's and the last window's."""
    first, last = halves(s, d)
    return C.three_methods(pairs(s, d).withColumnRenamed("weight", "partial"), edges(s, d), first, last)


@query
def c5_three_methods(s, d):
    return methods(s, d).withColumn("sign_same", F.col("sign_same").cast("string"))


@query
def c6_common_strong(s, d):
    return C.common_strong(methods(s, d))


# --- dynamics --------------------------------------------------------------------------------------------------------


@query
def n1_window_components(s, d):
    return N.window_components(kept(history(s, d)))


@query
def e22_rolling_history(s, d):
    return history(s, d)


@query
def n1_window_summary(s, d):
    return N.window_summary(history(s, d))


@query
def n2_window_nodes(s, d):
    return N.window_nodes(history(s, d))


@query
def n3_turnover(s, d):
    return N.turnover(history(s, d))


@query
def n4_edge_changes(s, d):
    return N.edge_changes(history(s, d))


@query
def n6_persistence(s, d):
    return N.persistence(history(s, d))


@query
def n7_persistence_by_relation(s, d):
    return N.persistence_by_relation(N.persistence(history(s, d)))


@query
def n9_static_vs_dynamic(s, d):
    return N.static_vs_dynamic(N.persistence(history(s, d)), static_edges(s, d), 0.5)


@query
def n9_static_dynamic_summary(s, d):
    return N.static_dynamic_summary(N.static_vs_dynamic(N.persistence(history(s, d)), static_edges(s, d), 0.5))


@query
def n10_scale_summary(s, d):
    return N.scale_summary(scales(s, d))


@query
def n11_multi_scale(s, d):
    return N.multi_scale(N.persistence(scales(s, d), ("window_size",)), SCALES)


@query
def n13_multi_scale_summary(s, d):
    return N.multi_scale_summary(N.multi_scale(N.persistence(scales(s, d), ("window_size",)), SCALES))


@query
def n34_ranked_nodes(s, d):
    return N.ranked_nodes(history(s, d), 5)


@query
def n14_centrality_stability(s, d):
    return N.centrality_stability(N.ranked_nodes(history(s, d), TOP))


@query
def n15_node_roles(s, d):
    return N.node_roles(N.centrality_stability(N.ranked_nodes(history(s, d), TOP)), TOP).select("entity", "degree_role", "strength_role", "combined_role")


@query
def n16_episodes(s, d):
    return N.episodes(history(s, d))


@query
def n17_lifecycle(s, d):
    return N.lifecycle(history(s, d))


@query
def n19_lifecycle_classes(s, d):
    return N.lifecycle_classes(N.lifecycle(history(s, d)))


@query
def n19_disagreements(s, d):
    h = kept(history(s, d))
    return N.disagreements(N.static_vs_dynamic(N.persistence(h), static_edges(s, d), 0.5), N.lifecycle(h).select("e1", "e2", "lifecycle_class", "n_episodes", "longest_run", "windows_selected"))


@query
def n22_relation_lifecycles(s, d):
    return N.relation_lifecycles(N.lifecycle(history(s, d)))


@query
def n22_active_non_core(s, d):
    return N.relation_lifecycles(N.lifecycle(history(s, d)), active_non_core=True)


@query
def a7_class_counts(s, d):
    """Pairs of every lifecycle class, those without pairs too."""
    return N.class_counts(N.lifecycle(history(s, d)), "lifecycle_class", [*N.CLASS_COLUMNS.values(), "Other"])


@query
def l2_class_order(s, d):
    """Classes in their own order, by relation within."""
    return N.by_class_order(N.lifecycle_classes(N.lifecycle(history(s, d))), "lifecycle_class", list(N.CLASS_COLUMNS.values()), F.col("relation").asc())


@query
def n20_transition_rates(s, d):
    return N.transition_rates(scales(s, d), ("window_size",))


def contrast(s, d):
    h = scales(s, d)
    k = ("window_size",)
    return N.relation_contrast(N.persistence_by_relation(N.persistence(h, k), k), N.transition_rates(h, k))


@query
def n21_relation_contrast(s, d):
    return contrast(s, d)


@query
def n23_evidence_matrix(s, d):
    table = N.multi_scale(N.persistence(scales(s, d), ("window_size",)), SCALES)
    return N.evidence_matrix(contrast(s, d), N.multi_scale_summary(table, True))


@query
def n24_state_table(s, d):
    return N.state_table(history(s, d))


@query
def n25_change_scores(s, d):
    return N.change_scores(kept(N.state_table(history(s, d))))


@query
def n27_threshold_summary(s, d):
    return N.threshold_summary(kept(N.change_scores(kept(N.state_table(history(s, d))))))


def regime_inputs(s, d):
    h = history(s, d)
    states = kept(N.state_table(h))
    return h, states, kept(N.regimes(states))


@query
def n28_regimes(s, d):
    return regime_inputs(s, d)[2]


@query
def n29_regime_summary(s, d):
    _, states, assigned = regime_inputs(s, d)
    return N.regime_summary(states, assigned)


@query
def n30_change_points(s, d):
    _, states, assigned = regime_inputs(s, d)
    return N.change_points(states, assigned)


@query
def n31_regime_persistence(s, d):
    h, _, assigned = regime_inputs(s, d)
    return N.regime_persistence(h, assigned)


@query
def n32_regime_structure(s, d):
    h, states, assigned = regime_inputs(s, d)
    return N.regime_structure(states, assigned, N.regime_persistence(h, assigned))


def regime_change(s, d):
    h, _, assigned = regime_inputs(s, d)
    return N.regime_edge_change(N.regime_persistence(h, assigned))


@query
def n33_regime_edge_change(s, d):
    return regime_change(s, d)


@query
def n33_regime_change_summary(s, d):
    return N.regime_change_summary(regime_change(s, d))


@query
def n35_regime_nodes(s, d):
    h, _, assigned = regime_inputs(s, d)
    return N.regime_nodes(N.ranked_nodes(h, 5), assigned)


@query
def n36_node_change(s, d):
    h, _, assigned = regime_inputs(s, d)
    return N.node_change(N.regime_nodes(N.ranked_nodes(h, 5), assigned))


@query
def n37_edge_burden(s, d):
    return N.edge_burden(regime_change(s, d))


@query
def n38_contributors(s, d):
    h, _, assigned = regime_inputs(s, d)
    changes = N.node_change(N.regime_nodes(N.ranked_nodes(h, 5), assigned))
    return N.contributors(changes, N.edge_burden(N.regime_edge_change(N.regime_persistence(h, assigned))))


@query
def n38_top_edges(s, d):
    """The ten pairs of each transition whose persistence changes most."""
    return N.top_rows(regime_change(s, d).select("regime_before", "regime_after", "e1", "e2", "abs_delta"), ["regime_before", "regime_after"], [F.round("abs_delta", 9).desc(), F.col("e1"), F.col("e2")], 10)


@query
def n38_top_nodes(s, d):
    """The ten nodes of each transition with the largest share of its persistence changes."""
    burden = N.edge_burden(regime_change(s, d)).select("regime_before", "regime_after", "entity", "abs_burden", "abs_burden_share")
    return N.top_rows(burden, ["regime_before", "regime_after"], [F.round("abs_burden_share", 9).desc(), F.col("entity")], 10)


@query
def l4_top_window_nodes(s, d):
    """The three strongest nodes of each window."""
    return N.top_rows(N.window_nodes(history(s, d)).select("window_id", "entity", "strength"), ["window_id"], [F.round("strength", 9).desc(), F.col("entity")], 3)


@query
def n39_window_pairs(s, d):
    return N.compare_windows(history(s, d), [(1, 2), (2, 5), (1, 10)])


@query
def n39_window_pair_summary(s, d):
    return N.window_pair_summary(N.compare_windows(history(s, d), [(1, 2), (2, 5), (1, 10)]))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["g1_threshold_edges"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (oracle.SQL | oracle_more.SQL).items() if k in _QUERIES}
