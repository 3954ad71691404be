import datetime as dt
import math

import numpy as np
import pytest

from netloom.operators import compare as C
from netloom.operators import dependence as D
from netloom.operators import dynamics as N
from netloom.operators import graph as G
from netloom.operators import sparse as S
from netloom.sources import tables as src

EDGES = "e1 string, e2 string, weight double"


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(0)
    x = np.exp(np.cumsum(r.normal(0, 0.1, (40, 5)) + r.normal(0, 0.1, (40, 1)), axis=0))
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), f"c{j}", float(x[i, j])) for i in range(40) for j in range(5)]
    return x, spark.createDataFrame(rows, "t date, entity string, value double")


def dense(df):
    return D.to_dense(df.select("row", "col", "value").toPandas())[1]


def test_returns_and_correlation(spark, panel):
    x, df = panel
    ret = np.diff(np.log(x), axis=0)
    returns = D.log_returns(src.on_spine(df))
    assert returns.count() == 39 * 5
    cov = D.covariance(returns)
    assert dense(cov) == pytest.approx(np.cov(ret.T))
    assert dense(D.correlation_of(cov)) == pytest.approx(np.corrcoef(ret.T))
    pairs = {(r.e1, r.e2): r["corr"] for r in D.pearson(returns, 10).collect()}
    assert pairs["c0", "c3"] == pytest.approx(np.corrcoef(ret.T)[0, 3])
    assert all(r["corr"] is None for r in D.pearson(returns, 40).collect())
    inverse = D.precision(cov)
    assert dense(inverse) == pytest.approx(np.linalg.inv(np.cov(ret.T)), rel=1e-6)
    theta = np.linalg.inv(np.cov(ret.T))
    assert dense(D.partial_of(inverse.drop("inverse_error"))) == pytest.approx(S.partial_matrix(theta), rel=1e-6)


def test_missing_values(spark):
    rows = [(dt.date(2024, 1, d), "a", v) for d, v in ((1, 1.0), (2, 2.0), (3, -1.0), (4, 4.0))] + [(dt.date(2024, 1, d), "b", 1.0) for d in (1, 2, 4)]
    spine = src.on_spine(spark.createDataFrame(rows, "t date, entity string, value double"))
    got = {(r.t.day, r.entity): r.ret for r in D.log_returns(spine).collect()}
    assert got[2, "a"] == pytest.approx(math.log(2)) and (3, "a") not in got  # a date without any return goes
    assert src.coverage_profile(spine).filter("entity = 'b'").first().n_missing == 1
    assert [r.entity for r in src.covered(spine, 0.9).select("entity").distinct().collect()] == []


def test_graphical_lasso_conditions(panel):
    x, _ = panel
    s = np.corrcoef(np.diff(np.log(x), axis=0).T)
    for alpha in (0.05, 0.2):
        r = S.graphical_lasso(s, alpha)
        cov, theta = np.linalg.inv(r["precision"]), r["precision"]
        off = ~np.eye(len(s), dtype=bool)
        assert r["converged"] and abs(np.diag(cov) - 1).max() < 1e-3
        assert (abs(cov - s)[off] <= alpha + 2e-3).all()
        on = off & (abs(theta) > 1e-8)
        assert (cov - s)[on] == pytest.approx(alpha * np.sign(theta[on]) * 1.0, abs=5e-3) or (s - cov)[on] == pytest.approx(alpha * -np.sign(theta[on]), abs=5e-3)


def test_resampling(spark, panel):
    _, df = panel
    returns = D.log_returns(src.on_spine(df))
    rng = np.random.default_rng(1)
    index = S.block_indices(39, 31, 5, rng)
    assert len(index) == 31 and max(index) < 39 and all(b - a == 1 for a, b in zip(index[:4], index[1:5], strict=True))
    fits = S.resample_fits(returns, 0.1, 6, 5)
    table = S.stability(fits)
    assert table.count() == 10 and table.agg({"valid_runs": "min"}).first()[0] == 6
    assert [tuple(r) for r in S.stability(S.resample_fits(returns, 0.1, 6, 5)).orderBy("e1", "e2").select("frequency").collect()] == [tuple(r) for r in table.orderBy("e1", "e2").select("frequency").collect()]
    assert S.time_folds(39, 5) == [(9, 15), (15, 21), (21, 27), (27, 33), (33, 39)]
    cv = S.cross_validate(spark, returns, [0.05, 0.2, 0.5])
    one = S.one_standard_error(cv).first()
    assert one.alpha_1se >= one.alpha_cv and cv.count() == 4 and S.only_alpha(S.one_standard_error(cv)) == one.alpha_1se
    assert S.common_ends(600)[0] == (511, 14)


def test_windows(spark, panel):
    _, df = panel
    returns = D.log_returns(src.on_spine(df))
    spans = S.windows(returns, 20, 7)
    assert {r.window_id: r["count"] for r in spans.groupBy("window_id").count().collect()} == {1: 20, 2: 20, 3: 20}
    assert S.rolling_glasso(returns, 0.1, 20, 7).count() == 3 * 10


def test_graph_measures(spark):
    nodes = spark.createDataFrame([(x, "g" if x < "c" else "h") for x in "abcdef"], "entity string, grp string")
    edges = spark.createDataFrame([("a", "b", 0.9, 1.0), ("b", "c", 0.8, 2.0), ("a", "c", -0.5, 4.0), ("d", "e", 0.6, 1.0)], EDGES + ", distance double")
    degree = {r.entity: r for r in G.node_degrees(nodes, edges).collect()}
    assert degree["b"].degree == 2 and degree["f"].isolated and degree["d"].leaf and degree["f"].mean_weight is None
    assert degree["a"].strength == pytest.approx(1.4) and degree["a"].weighted_degree == pytest.approx(0.4)
    comp = {r.entity: (r.component, r.component_size) for r in G.components(nodes, edges).collect()}
    assert comp == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1)}
    path = {r.entity: r for r in G.path_centrality(nodes, edges).collect()}
    assert path["b"].betweenness == pytest.approx(2 / 20) and path["a"].closeness == pytest.approx(2 / 4 * 2 / 5)
    hops = {r.entity: r for r in G.path_centrality(nodes, edges, weighted=False).collect()}
    assert hops["b"].betweenness == 0 and hops["a"].closeness == pytest.approx(2 / 2 * 2 / 5)
    row = G.network_summary(nodes, edges, nodes).first()
    assert (row.n_nodes, row.n_edges, row.n_components, row.n_isolated, row.same_edges) == (6, 4, 3, 1, 2)
    tree = {(r.e1, r.e2) for r in G.spanning_tree(edges.select("e1", "e2", "weight")).collect()}
    assert tree == {("a", "b"), ("b", "c"), ("d", "e")}
    assert G.assortativity(edges.limit(0), nodes).first()[0] is None


def test_comparison(spark):
    a = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8)], EDGES)
    b = spark.createDataFrame([("a", "b", 0.3), ("a", "c", 0.2)], EDGES)
    row = C.overlap(a, b).first()
    assert (row.common, row.a_only, row.b_only, row.union_edges) == (1, 1, 1, 3) and row.jaccard == pytest.approx(1 / 3)
    assert C.overlap(a.limit(0), b.limit(0)).first().jaccard is None
    pairs = spark.createDataFrame([("a", "b", 0.6, 0.01), ("a", "c", 0.6, -0.1), ("a", "d", 0.6, 0.3), ("a", "e", 0.6, 0.1), ("b", "c", 0.1, 0.3), ("b", "d", 0.1, 0.05)], "e1 string, e2 string, pearson double, partial double")
    kinds = [r.relation_type for r in C.pair_comparison(pairs).orderBy("e1", "e2").collect()]
    assert kinds == [C.RELATIONS[k] for k in ("vanished", "reversed", "kept", "weakened", "strengthened", "other")]


@pytest.fixture(scope="module")
def history(spark):
    bits = {("a", "b"): "111111", ("a", "c"): "110011", ("b", "c"): "000100", ("a", "d"): "101010"}
    rows = [(w + 1, dt.date(2024, 1, 1), dt.date(2024, 2, 1 + w), e1, e2, 0.5 if b == "1" else 0.1, b == "1", (e1, e2) == ("a", "b")) for (e1, e2), s in bits.items() for w, b in enumerate(s)]
    return spark.createDataFrame(rows, "window_id int, window_start date, network_date date, e1 string, e2 string, weight double, selected boolean, same_grp boolean")


def test_turnover_and_lifecycle(history):
    first = N.turnover(history).orderBy("window_to").first()
    assert (first.edges_from, first.common_edges, first.lost_edges, first.gained_edges) == (3, 2, 1, 0) and first.jaccard == pytest.approx(2 / 3)
    life = {(r.e1, r.e2): r for r in N.lifecycle(history).collect()}
    assert life["a", "b"].lifecycle_class == "Persistent core" and life["b", "c"].lifecycle_class == "Rare"
    assert life["a", "d"].lifecycle_class == "Intermittent" and life["a", "d"].selection_sequence == "101010"
    assert life["a", "c"].lifecycle_class == "Two-episode transitional" and life["a", "c"].longest_run_start == dt.date(2024, 2, 1)
    assert N.edge_changes(history).count() == sum(r.switch_count for r in life.values())
    counts = {r["class"]: r.n for r in N.class_counts(N.lifecycle(history), "lifecycle_class", ["Rare", "Other"]).collect()}
    assert counts == {"Rare": 1, "Other": 0}


def test_empty_networks_have_jaccard_one(history):
    from pyspark.sql import functions as F

    row = N.turnover(history.withColumn("selected", F.lit(False))).first()
    assert row.jaccard == 1.0 and row.turnover == 0.0 and row.cross_change_share is None


def test_states_and_regimes(history):
    states = N.state_table(history)
    first = states.orderBy("network_date").first()
    assert first.turnover is None and first.edge_count == 3
    scores = N.change_scores(states).orderBy("network_date").first()
    assert scores.change_type == "Initial network" and scores.change_source == "No change" and scores.rewiring_share == 0.0
    x = np.array([[0.0], [0.1], [0.0], [5.0], [5.1], [5.0]])
    best = N.best_segments(x, 3, 3)
    assert best[1]["ends"] == [3, 6] and best[1]["rss"] < best[0]["rss"] and len(best) == 2


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 3.0), (1, 3.0), (1, 1.0)], "g int, v double")
    assert sorted(r[0] for r in df.select(N.average_rank(["g"], "v")).collect()) == [1.0, 2.5, 2.5, 4.0]
