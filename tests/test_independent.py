"""Dense estimation, paths, trees, turnover and lifecycles against small versions written another way (numpy and plain loops)."""

import itertools
import math
import random

import numpy as np
import pytest

from netloom.operators import compare as C
from netloom.operators import dependence as D
from netloom.operators import dynamics as N
from netloom.operators import graph as G
from netloom.operators import sparse as S
from netloom.sources import tables as src

NAMES = [f"s{i}" for i in range(6)]


def panel(n=80, seed=1, p=6):
    """Returns of p entities with a common factor, as an array."""
    r = np.random.default_rng(seed)
    common = r.normal(size=(n, 1))
    return 0.02 * (common * np.linspace(1.2, 0.0, p) + r.normal(size=(n, p)) @ np.triu(0.3 * np.ones((p, p)), 1).T + r.normal(size=(n, p)))


def frame(spark, x):
    rows = [(k + 1, NAMES[j], float(x[k, j])) for k in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "k int, entity string, ret double").selectExpr("date_add(date'2024-01-01', k) AS t", "k", "entity", "ret")


def matrix_frame(spark, m):
    return spark.createDataFrame([(NAMES[i], NAMES[j], float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "row string, col string, value double")


def array(df, value="value"):
    out = np.full((len(NAMES), len(NAMES)), np.nan)
    for r in df.collect():
        out[NAMES.index(r.row), NAMES.index(r.col)] = r[value]
    return out


def admm(s, alpha, rho=1.0, steps=4000):
    """The sparse precision matrix by alternating directions: another algorithm for the same minimum."""
    z = u = np.zeros_like(s)
    for _ in range(steps):
        w, q = np.linalg.eigh(rho * (z - u) - s)
        t = (q * ((w + np.sqrt(w**2 + 4 * rho)) / (2 * rho))) @ q.T
        z = np.sign(t + u) * np.maximum(np.abs(t + u) - alpha / rho, 0)
        np.fill_diagonal(z, (t + u).diagonal())
        u = u + t - z
    return z


def partials(theta):
    d = np.sqrt(theta.diagonal())
    return -theta / np.outer(d, d)


def test_precision_and_partial_correlation(spark):
    x = panel()
    cov = np.cov(x.T)
    inverse = np.linalg.solve(cov, np.eye(6))
    got = D.precision(D.covariance(frame(spark, x)))
    assert array(got) == pytest.approx(inverse, rel=1e-6) and got.first().inverse_error < 1e-8
    # the partial correlation is that of the residuals of both on all others
    want = np.eye(6)
    for i, j in itertools.permutations(range(6), 2):
        rest = np.column_stack([np.ones(len(x)), x[:, [k for k in range(6) if k not in (i, j)]]])
        a, b = (x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0] for k in (i, j))
        want[i, j] = a @ b / math.sqrt((a @ a) * (b @ b))
    assert array(D.partial_of(got.drop("inverse_error"))) == pytest.approx(want, abs=1e-6)
    agree = D.correlation_agreement(frame(spark, x)).first()
    assert agree.agree and agree.n_cells == 36


def test_describe(spark):
    x = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, None]
    got = {r.statistic: r.value for r in D.describe(spark.createDataFrame([(v,) for v in x], "v double"), "v").collect()}
    known = np.array(x[:-1])
    assert got == pytest.approx({"count": 6, "mean": known.mean(), "std": known.std(ddof=1), "min": 1, "25%": np.percentile(known, 25), "50%": np.percentile(known, 50), "75%": np.percentile(known, 75), "max": 9})


@pytest.mark.parametrize("alpha", [0.05, 0.2, 0.5])
def test_graphical_lasso_finds_the_minimum(spark, alpha):
    s = np.corrcoef(panel().T)
    want = admm(s, alpha)
    got = array(S.glasso(matrix_frame(spark, s), alpha))
    assert got == pytest.approx(want, abs=3e-3)
    edges = {(r.e1, r.e2): r.weight for r in S.support(S.glasso(matrix_frame(spark, s), alpha)).collect()}
    sure = np.abs(want) > 0.01
    assert {(NAMES[i], NAMES[j]) for i in range(6) for j in range(i + 1, 6) if sure[i, j]} <= set(edges)
    assert all(v == pytest.approx(partials(want)[NAMES.index(a), NAMES.index(b)], abs=5e-3) for (a, b), v in edges.items())


def test_path_by_another_solver(spark):
    s = np.corrcoef(panel(seed=4).T)
    most = float(np.abs(s - np.eye(6)).max())
    assert S.alpha_max(matrix_frame(spark, s)) == pytest.approx(most)
    grid = S.alpha_grid(most, 6, 0.1)
    assert grid == pytest.approx([0.1 * most * (1.05 / 0.1) ** (i / 5) for i in range(6)])
    for r in S.regularization_path(spark, matrix_frame(spark, s), grid).collect():
        theta = admm(s, r.alpha)
        strong, weak = (int((np.abs(theta[np.triu_indices(6, 1)]) > least).sum()) for least in (5e-3, 1e-9))
        assert strong <= r.n_edges <= max(weak, strong) + 1 and r.density == pytest.approx(r.n_edges / 15) and r.mean_degree == pytest.approx(r.n_edges / 3)
        assert r.max_abs_partial == pytest.approx(np.abs(partials(theta)[np.triu_indices(6, 1)]).max(initial=0.0), abs=5e-3)


def test_cross_validation_by_another_solver(spark):
    x = panel(62, 7)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    # fixed values: 62 dates make five expanding folds with tests of ten
    folds = [(range(a), range(a, a + 10)) for a in (12, 22, 32, 42, 52)]
    got = {r.alpha: r for r in S.cross_validate(spark, frame(spark, x), [0.1, 0.4]).collect()}
    for alpha in (0.0, 0.1, 0.4):
        scores = []
        for train, test in folds:
            a, b = z[list(train)], z[list(test)]
            theta = np.linalg.inv(a.T @ a / len(a)) if alpha == 0 else admm(a.T @ a / len(a), alpha)
            scores.append((np.linalg.slogdet(theta)[1] - np.trace(b.T @ b / 10 @ theta) - 6 * np.log(2 * np.pi)) / 2)
        assert got[alpha].mean_score == pytest.approx(np.mean(scores), abs=0.02) and got[alpha].sd_score == pytest.approx(np.std(scores), abs=0.02)
    assert sum(r.selected for r in got.values()) == 1 and max(got.values(), key=lambda r: r.mean_score).selected


def test_one_standard_error(spark):
    # fixed values: the best mean is -7.0 with a standard error of 0.5 / sqrt(5) = 0.2236, so -7.2 is within it and -7.3 isn't
    table = [(0.0, -9.0, 0.1), (0.1, -7.1, 0.4), (0.2, -7.0, 0.5), (0.3, -7.2, 0.6), (0.4, -7.3, 0.1)]
    got = S.one_standard_error(spark.createDataFrame(table, "alpha double, mean_score double, sd_score double")).first()
    assert (got.alpha_cv, got.alpha_1se) == (0.2, 0.3) and got.se == pytest.approx(0.2236, abs=1e-4)


def test_stability_counts(spark):
    x = panel(60, 9)
    fits = S.resample_fits(frame(spark, x), 0.2, runs=12, block=6)
    rows = fits.collect()
    by = {}
    for r in rows:
        by.setdefault((r.e1, r.e2), []).append(r.weight)
    for r in S.stability(fits).collect():
        on = [w for w in by[r.e1, r.e2] if w]
        assert (r.selected_count, r.valid_runs, r.frequency) == (len(on), 12, pytest.approx(len(on) / 12))
        assert r.dominant_sign == ("never_selected" if not on else "positive" if sum(w > 0 for w in on) * 2 >= len(on) else "negative")
    # each draw by itself: blocks of consecutive dates, 48 of 60, and the same fit by another solver
    rng = np.random.default_rng(20260814)
    index = S.block_indices(60, 48, 6, rng)
    assert len(index) == 48 and all(b == a + 1 for i, (a, b) in enumerate(itertools.pairwise(index)) if i % 6 != 5)
    z = (x[index] - x[index].mean(axis=0)) / x[index].std(axis=0)
    want = partials(admm(z.T @ z / 48, 0.2))
    assert all(r.weight == pytest.approx(want[NAMES.index(r.e1), NAMES.index(r.e2)], abs=1e-2) for r in rows if r.run == 0)


def test_rolling_windows(spark):
    x = panel(50, 11)
    got = S.rolling_glasso(frame(spark, x), 0.2, size=20, step=10).collect()
    assert {r.window_id for r in got} == {1, 2, 3, 4}
    for w in range(4):
        part = x[10 * w : 10 * w + 20]
        want = partials(admm(np.corrcoef(part.T), 0.2))
        assert all(r.weight == pytest.approx(want[NAMES.index(r.e1), NAMES.index(r.e2)], abs=1e-2) for r in got if r.window_id == w + 1)


def random_graph(seed, p=6, share=0.5):
    r = random.Random(seed)
    return [(a, b, round(r.uniform(0.2, 0.9), 3)) for a, b in itertools.combinations(NAMES[:p], 2) if r.random() < share]


@pytest.mark.parametrize("seed,weighted", [(1, True), (2, True), (3, False), (4, False)])
def test_path_measures_by_listing_all_paths(spark, seed, weighted):
    links = random_graph(seed)
    length = {}
    for a, b, w in links:
        length[a, b] = length[b, a] = math.sqrt(2 * (1 - w)) if weighted else 1.0
    best = {}
    for a, b in itertools.permutations(NAMES, 2):
        paths = [(a, *mid, b) for k in range(5) for mid in itertools.permutations([x for x in NAMES if x not in (a, b)], k)]
        paths = [(sum(length[s] for s in itertools.pairwise(p)), p) for p in paths if all(s in length for s in itertools.pairwise(p))]
        if paths:
            best[a, b] = [p for p in paths if p[0] <= min(paths)[0] + 1e-12]
    nodes, edges = spark.createDataFrame([(x, "g") for x in NAMES], "entity string, grp string"), spark.createDataFrame(links, "e1 string, e2 string, weight double").withColumn("distance", G.distance())
    for r in G.path_centrality(nodes, edges, weighted).collect():
        through = sum(sum(r.entity in p[1:-1] for _, p in ps) / len(ps) for ps in best.values()) / 20
        far = [ps[0][0] for (a, _), ps in best.items() if a == r.entity]
        close = len(far) / sum(far) * len(far) / 5 if far else 0.0
        assert (r.betweenness, r.closeness) == (pytest.approx(through), pytest.approx(close))


def test_sources_are_dealt_over_tasks(spark, monkeypatch):
    nodes, edges = spark.createDataFrame([(x, "g") for x in NAMES], "entity string, grp string"), spark.createDataFrame(random_graph(5), "e1 string, e2 string, weight double").withColumn("distance", G.distance())
    want = {r.entity: (r.betweenness, r.closeness) for r in G.path_centrality(nodes, edges).collect()}
    monkeypatch.setattr(G, "SOURCES", 2)
    assert {r.entity: (pytest.approx(r.betweenness), pytest.approx(r.closeness)) for r in G.path_centrality(nodes, edges).collect()} == want


def test_spanning_tree_by_trying_all_trees(spark):
    links = random_graph(8, 5, 1.0)

    def joins(tree):
        name = {x: x for x in NAMES[:5]}
        for a, b, _ in tree:
            name = {x: name[a] if n == name[b] else n for x, n in name.items()}
        return len(set(name.values())) == 1

    want = min((t for t in itertools.combinations(links, 4) if joins(t)), key=lambda t: sum(math.sqrt(2 * (1 - w)) for _, _, w in t))
    pairs = spark.createDataFrame(links, "e1 string, e2 string, weight double").repartition(4)
    assert {(r.e1, r.e2) for r in G.spanning_tree(pairs).collect()} == {(a, b) for a, b, _ in want}


# fixed values: five pairs over eight windows, and what follows by the definitions
BITS = {("a", "b"): "11111111", ("a", "c"): "11100000", ("a", "d"): "10110101", ("b", "c"): "01100011", ("b", "d"): "00000010"}
CLASSES = {("a", "b"): "Persistent core", ("a", "c"): "Regime-dependent", ("a", "d"): "Intermittent", ("b", "c"): "Two-episode transitional", ("b", "d"): "Rare"}


@pytest.fixture(scope="module")
def history(spark):
    rows = [(w + 1, w + 1, w + 1, a, b, 0.5 if x == "1" else 0.1, x == "1", a == "a") for (a, b), bits in BITS.items() for w, x in enumerate(bits)]
    return spark.createDataFrame(rows, "window_id int, window_start int, network_date int, e1 string, e2 string, weight double, selected boolean, same_grp boolean")


def test_turnover_and_lifecycles(history):
    on = [{k for k, bits in BITS.items() if bits[w] == "1"} for w in range(8)]
    for r in N.turnover(history).collect():
        was, now = on[r.window_from - 1], on[r.window_to - 1]
        assert (r.common_edges, r.lost_edges, r.gained_edges) == (len(was & now), len(was - now), len(now - was))
        assert r.turnover == pytest.approx(1 - len(was & now) / len(was | now)) and r.lost_rate == pytest.approx(len(was - now) / len(was))
    table = N.lifecycle(history)
    got = {(r.e1, r.e2): r for r in table.collect()}
    assert {k: r.lifecycle_class for k, r in got.items()} == CLASSES and {k: r.selection_sequence for k, r in got.items()} == BITS
    assert {k: (r.n_episodes, r.longest_run) for k, r in got.items()} == {k: (len(runs := [x for x in bits.split("0") if x]), max(map(len, runs))) for k, bits in BITS.items()}
    by = {r.relation: r for r in N.relation_lifecycles(table).collect()}
    assert (by["Same"].n_pairs, by["Same"].intermittent_edges, by["Cross"].rare_rate) == (3, 1, 0.5)
    active = {r.relation: r.n_pairs for r in N.relation_lifecycles(table, active_non_core=True).collect()}
    assert active == {"Same": 2, "Cross": 1}
    order = [r.lifecycle_class for r in N.by_class_order(N.lifecycle_classes(table), "lifecycle_class", list(N.CLASS_COLUMNS.values())).collect()]
    assert order == list(N.CLASS_COLUMNS.values())
    parts = {r.window_id: (r.n_components, r.largest) for r in N.window_components(history).collect()}
    assert parts[1] == (1, 4)
    assert set(parts) == set(range(1, 9)) and parts[5] == (3, 2)


def test_disagreements_and_retention(spark, history):
    static = spark.createDataFrame([("a", "b", False), ("a", "c", True)], "e1 string, e2 string, static_stable boolean")
    got = {(r.e1, r.e2): (r.stability_class, r.lifecycle_class) for r in N.disagreements(N.static_vs_dynamic(N.persistence(history), static, 0.8), N.lifecycle(history)).collect()}
    assert got == {("a", "b"): ("Dynamic persistent only", "Persistent core"), ("a", "c"): ("Static stable only", "Regime-dependent")}
    stable = spark.createDataFrame([(5, "a", "b", 0.95), (5, "a", "c", 0.85), (9, "a", "b", 0.5), (9, "a", "c", 0.9)], "block_length int, e1 string, e2 string, frequency double")
    base = spark.createDataFrame([("a", "b"), ("b", "c")], "e1 string, e2 string")
    assert {r.block_length: (r.n_stable, r.n_core, r.n_retained, r.retention) for r in S.baseline_retention(stable, base).collect()} == {5: (2, 1, 1, 0.5), 9: (1, 1, 0, 0.0)}


def test_tree_survival(spark):
    rows = [(1, "a", "b", 0.9), (1, "b", "c", 0.8), (1, "a", "c", 0.1), (2, "a", "b", 0.9), (2, "b", "c", 0.1), (2, "a", "c", 0.8), (3, "a", "b", 0.9), (3, "b", "c", 0.1), (3, "a", "c", 0.8)]
    trees = G.spanning_trees(spark.createDataFrame(rows, "window_id int, e1 string, e2 string, weight double"))
    assert {(r.window_from, r.window_to): r.survival for r in G.tree_survival(trees).collect()} == {(1, 2): 0.5, (2, 3): 1.0}


def test_three_methods(spark):
    edges = lambda rows: spark.createDataFrame(rows, "e1 string, e2 string, weight double")
    spine = edges([("a", "b", 0.4), ("a", "c", -0.3), ("b", "c", 0.01)]).withColumnRenamed("weight", "partial")
    table = C.three_methods(spine, edges([("a", "b", 0.4), ("a", "c", -0.3)]), edges([("b", "c", 0.1)]), edges([("a", "b", 0.3), ("b", "c", 0.2)]))
    got = {(r.e1, r.e2): (r.main_edge_type, r.sign_same, r.in_cv) for r in table.collect()}
    assert got == {("a", "b"): ("Common", True, False), ("a", "c"): ("Partial-only", None, False), ("b", "c"): ("GLasso-1SE-only", None, True)}
    one = C.common_strong(table).first()
    assert (one.n_common, one.sign_agreement) == (1, 1.0)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("000001", "é", 1.5), ("000002", None, 2.5)], "code string, name string, weight double").coalesce(1)
    src.write_csv(df, str(tmp_path / "t"))
    (part,) = (tmp_path / "t").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfcode,name,weight")
    back = src.read_table(spark, str(tmp_path / "t"), {"weight": "double"})
    assert back.columns == ["code", "name", "weight"] and [tuple(r) for r in back.orderBy("code").collect()] == [("000001", "é", 1.5), ("000002", None, 2.5)]
    assert src.read_optional(spark, str(tmp_path / "none"), lambda: "fallback") == "fallback"
    assert src.read_optional(spark, str(tmp_path / "t"), lambda: "fallback").count() == 2
    (tmp_path / "e.csv").write_text("stock_2,stock_1,w\n000001,000002,0.5\n", encoding="utf-8-sig")
    assert [tuple(r) for r in src.read_edges(spark, str(tmp_path / "e.csv"), "w").collect()] == [("000001", "000002", 0.5)]
    (tmp_path / "m.csv").write_text("code,000001,000002\n000001,1,0.5\n000002,0.5,1\n", encoding="utf-8-sig")
    assert {(r.row, r.col): r.value for r in src.read_matrix(spark, str(tmp_path / "m.csv")).collect()}["000002", "000001"] == 0.5
    (tmp_path / "p.csv").write_text("date,000001,000002\n2024-01-02,1.5,\n2024-01-03,2.5,3.5\n", encoding="utf-8-sig")
    assert src.read_wide_panel(spark, str(tmp_path / "p.csv")).filter("value IS NOT NULL").count() == 3


def test_rolling_correlation_keeps_its_digits_and_its_windows(spark):
    x = panel(40, 13) + 1e5  # a large mean costs digits where it isn't taken off
    df = frame(spark, x).filter("NOT (entity = 's2' AND k IN (5, 6, 20))")  # rows that are missing, not null
    dim = spark.createDataFrame([(n, "g") for n in NAMES], "entity string, grp string")
    for r in N.rolling_pearson(df, dim, 12, 4).collect():
        last = 11 + (r.window_id - 1) * 4
        rows = [k for k in range(last - 11, last + 1) if not ("s2" in (r.e1, r.e2) and k + 1 in (5, 6, 20))]
        assert r.weight == pytest.approx(np.corrcoef(x[rows, NAMES.index(r.e1)], x[rows, NAMES.index(r.e2)])[0, 1], abs=1e-6)
