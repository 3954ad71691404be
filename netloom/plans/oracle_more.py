"""More DuckDB SQL of the registered queries: trees, paths, dense matrices, stability counts and top lists."""

from __future__ import annotations

from .oracle import BURDEN, H, HALVES, HP, LIFE, PAIRS, RCHANGE, SCALES, TWO, WITH, hist, nodes, persistent, r, rs

# --- trees -----------------------------------------------------------------------------------------------------------

#: An edge is in the tree if its ends aren't joined by edges that come before it.
TREES = """,
wr AS (SELECT window_id, e1, e2, weight, sqrt(2 * (1 - weight)) AS distance, row_number() OVER (PARTITION BY window_id ORDER BY sqrt(2 * (1 - weight)), e1, e2) AS n FROM h WHERE weight IS NOT NULL),
wb AS (SELECT window_id, e1 AS a, e2 AS b, n FROM wr UNION ALL SELECT window_id, e2, e1, n FROM wr),
ww AS (SELECT window_id, n AS edge, e1 AS at FROM wr UNION SELECT ww.window_id, ww.edge, wb.b FROM ww JOIN wb ON wb.window_id = ww.window_id AND wb.a = ww.at AND wb.n < ww.edge),
wt AS (SELECT window_id, e1, e2, weight, distance FROM wr x WHERE NOT EXISTS (SELECT 1 FROM ww WHERE ww.window_id = x.window_id AND ww.edge = x.n AND ww.at = x.e2))"""
TREE = PAIRS + """,
tr AS (SELECT *, sqrt(2 * (1 - weight)) AS d, row_number() OVER (ORDER BY sqrt(2 * (1 - weight)), e1, e2) AS n FROM prs),
tb AS (SELECT e1 AS a, e2 AS b, n FROM tr UNION ALL SELECT e2, e1, n FROM tr),
tw AS (SELECT n AS edge, e1 AS at FROM tr UNION SELECT tw.edge, tb.b FROM tw JOIN tb ON tb.a = tw.at AND tb.n < tw.edge),
tree AS (SELECT e1, e2, d FROM tr x WHERE NOT EXISTS (SELECT 1 FROM tw WHERE tw.edge = x.n AND tw.at = x.e2)),
ends AS (SELECT e1 AS a, e2 AS b, d FROM tree UNION ALL SELECT e2, e1, d FROM tree),
top AS (SELECT a FROM ends GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
down AS (SELECT a AS entity, CAST(NULL AS VARCHAR) AS parent, 0.0::DOUBLE AS d, 0 AS level FROM top
         UNION ALL SELECT ends.b, down.entity, ends.d, down.level + 1 FROM down JOIN ends ON ends.a = down.entity WHERE ends.b IS DISTINCT FROM down.parent),
above AS (SELECT entity, entity AS ancestor FROM down UNION ALL SELECT above.entity, down.parent FROM above JOIN down ON down.entity = above.ancestor WHERE down.parent IS NOT NULL),
leaves AS (SELECT ancestor AS entity, count(*) AS leaves FROM above WHERE entity NOT IN (SELECT parent FROM down WHERE parent IS NOT NULL) GROUP BY 1),
shares AS (SELECT down.*, own.leaves, (sum(own.leaves) OVER (PARTITION BY parent ORDER BY down.entity) - own.leaves) / up.leaves AS from_share, sum(own.leaves) OVER (PARTITION BY parent ORDER BY down.entity) / up.leaves AS to_share
           FROM down JOIN leaves own ON own.entity = down.entity LEFT JOIN leaves up ON up.entity = down.parent),
laid AS (SELECT entity, level, 0.0::DOUBLE AS low, 2 * pi() AS high, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM shares WHERE parent IS NULL
         UNION ALL SELECT c.entity, c.level, p.low + (p.high - p.low) * c.from_share, p.low + (p.high - p.low) * c.to_share,
                          p.x + 5 * c.d * cos(p.low + (p.high - p.low) * (c.from_share + c.to_share) / 2), p.y + 5 * c.d * sin(p.low + (p.high - p.low) * (c.from_share + c.to_share) / 2)
         FROM laid p JOIN shares c ON c.parent = p.entity)"""


# --- shortest paths --------------------------------------------------------------------------------------------------


def paths(name: str, edges: str, step: str = "distance") -> str:
    """Betweenness and closeness by squaring the matrix of distances (2 ** 6 steps) and listing all shortest paths."""
    n = name
    out = f""",
{n}i AS (SELECT e1 AS a, e2 AS b, {step} AS d FROM {edges} UNION ALL SELECT e2, e1, {step} FROM {edges}),
{n}0 AS (SELECT a, b, d FROM {n}i UNION ALL SELECT entity, entity, 0.0 FROM dim)"""
    for k in range(6):
        out += f""",
{n}{k + 1} AS MATERIALIZED (SELECT p.a, q.b, min(p.d + q.d) AS d FROM {n}{k} p JOIN {n}{k} q ON q.a = p.b GROUP BY 1, 2)"""
    return out + f""",
{n}w AS (SELECT a AS s, a AS e, 0.0::DOUBLE AS d, [a] AS nodes FROM {n}6 WHERE a = b
         UNION ALL SELECT w.s, i.b, w.d + i.d, list_append(w.nodes, i.b) FROM {n}w w JOIN {n}i i ON i.a = w.e JOIN {n}6 m ON m.a = w.s AND m.b = i.b WHERE abs(w.d + i.d - m.d) <= 1e-12),
{n}c AS (SELECT s, e, count(*) AS paths FROM {n}w GROUP BY 1, 2),
{n}t AS (SELECT inner_node AS entity, sum(1.0 / paths) AS total FROM (SELECT w.s, w.e, unnest(list_slice(w.nodes, 2, len(w.nodes) - 1)) AS inner_node FROM {n}w w WHERE len(w.nodes) > 2) x JOIN {n}c c ON c.s = x.s AND c.e = x.e GROUP BY 1),
{n}f AS (SELECT a AS entity, sum(d) AS far, count(*) AS reached FROM {n}6 GROUP BY 1),
{n} AS (SELECT dim.entity, coalesce(t.total, 0) / nullif((SELECT (count(*) - 1) * (count(*) - 2) FROM dim), 0) AS betweenness,
        CASE WHEN f.far > 0 THEN (f.reached - 1) / f.far * (f.reached - 1) / (SELECT count(*) - 1 FROM dim) ELSE 0 END AS closeness
        FROM dim LEFT JOIN {n}t t USING (entity) LEFT JOIN {n}f f USING (entity))"""


# --- dense matrices of the daily event panel -------------------------------------------------------------------------

EVENTS = r"""
ep AS (SELECT CAST(ts AS DATE) AS t, event_type AS entity, sum(value) AS value FROM events GROUP BY 1, 2),
ed AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM ep)),
es AS (SELECT ed.k, n.entity, CASE WHEN ep.value > 0 THEN ep.value END AS value FROM ed CROSS JOIN (SELECT DISTINCT entity FROM ep) n LEFT JOIN ep ON ep.t = ed.t AND ep.entity = n.entity),
er AS (SELECT k, entity, ln(value) - lag(ln(value)) OVER (PARTITION BY entity ORDER BY k) AS ret FROM es),
ef AS (SELECT * FROM er WHERE k IN (SELECT k FROM er GROUP BY k HAVING count(ret) = (SELECT count(DISTINCT entity) FROM ep))),
m AS MATERIALIZED (SELECT a.entity AS i, b.entity AS j, covar_samp(a.ret, b.ret) AS v FROM ef a JOIN ef b ON a.k = b.k GROUP BY 1, 2)"""


def inverse(steps: int = 60) -> str:
    """X <- X (2 I - M X), which squares the error of each step."""
    out = EVENTS + """,
x0 AS MATERIALIZED (SELECT i, j, v / ((SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i)) * (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY j))) AS v FROM m)"""
    for k in range(steps):
        out += f""",
y{k} AS MATERIALIZED (SELECT m.i, x.j, (CASE WHEN m.i = x.j THEN 2.0 ELSE 0.0 END) - sum(m.v * x.v) AS v FROM m JOIN x{k} x ON x.i = m.j GROUP BY m.i, x.j),
x{k + 1} AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM x{k} x JOIN y{k} y ON y.i = x.j GROUP BY x.i, y.j)"""
    return out + f""",
inv AS MATERIALIZED (SELECT * FROM x{steps})"""


def largest(name: str, matrix: str, steps: int = 30) -> str:
    """The largest eigenvalue of a symmetric, positive semidefinite matrix, by squaring it until one direction is left."""
    out = f""",
{name}0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"""
    for k in range(steps):
        out += f""",
{name}q{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}{k} a JOIN {name}{k} b ON b.i = a.j GROUP BY a.i, b.j),
{name}{k + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {name}q{k} WHERE i = j) AS v FROM {name}q{k})"""
    return out + f""",
{name} AS MATERIALIZED (SELECT sum(p.v * {matrix}.v) AS value FROM {name}{steps} p JOIN {matrix} ON {matrix}.i = p.i AND {matrix}.j = p.j)"""


EIGEN = EVENTS + largest("hi", "m") + """,
shifted AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN (SELECT value FROM hi) ELSE 0.0 END - v AS v FROM m)""" + largest("gap", "shifted")

# --- stability -------------------------------------------------------------------------------------------------------

FITS = SCALES + """,
fit AS (SELECT window_size AS block_length, window_id AS run, e1, e2, CASE WHEN selected THEN weight ELSE 0.0 END AS weight, weight IS NOT NULL AS valid FROM h)"""
STABLE = FITS + """,
sb0 AS (SELECT block_length, e1, e2, count_if(valid AND weight <> 0) AS selected_count, count_if(valid) AS valid_runs, avg(weight) FILTER (valid AND weight <> 0) AS mean_when_selected, stddev_pop(weight) FILTER (valid AND weight <> 0) AS sd_when_selected,
        count_if(valid AND weight > 0) AS pos, count_if(valid AND weight < 0) AS neg FROM fit GROUP BY 1, 2, 3),
sb AS (SELECT * EXCLUDE (pos, neg), selected_count / nullif(valid_runs, 0) AS frequency, pos / nullif(selected_count, 0) AS positive_fraction, neg / nullif(selected_count, 0) AS negative_fraction, greatest(pos, neg) / nullif(selected_count, 0) AS sign_consistency,
       CASE WHEN selected_count = 0 THEN 'never_selected' WHEN pos >= neg THEN 'positive' ELSE 'negative' END AS dominant_sign,
       CASE WHEN selected_count / nullif(valid_runs, 0) >= 0.9 THEN 'core' WHEN selected_count / nullif(valid_runs, 0) >= 0.8 THEN 'stable' WHEN selected_count / nullif(valid_runs, 0) >= 0.5 THEN 'moderate' ELSE 'unstable' END AS stability_class FROM sb0)"""
_SIZES = (18, 24, 36)
_RATES = ("persistent_core", "regime_dependent", "intermittent", "two_episode", "rare")
_CLASSES = ("Persistent core", "Regime-dependent", "Intermittent", "Two-episode transitional", "Rare")


def relation_lifecycles(where: str) -> str:
    counts = ", ".join(f"count_if(lifecycle_class = '{v}') AS {c}_edges" for c, v in zip(_RATES, _CLASSES, strict=True))
    means = ", ".join(r(f"avg({a})", f"mean_{b}") for a, b in (("persistence", "persistence"), ("transition_rate", "transition_rate"), ("n_episodes", "episodes"), ("longest_run", "longest_run"), ("longest_run_share", "longest_run_share")))
    rates = ", ".join(r(f"count_if(lifecycle_class = '{v}') / count(*)", f"{c}_rate") for c, v in zip(_RATES, _CLASSES, strict=True))
    return WITH + H + LIFE + f" SELECT CASE WHEN same_grp THEN 'Same' ELSE 'Cross' END AS relation, count(*) AS n_pairs, {means}, {counts}, {rates} FROM lf WHERE {where} GROUP BY 1"


METHODS = HP + HALVES + """,
mt AS (SELECT p.e1, p.e2, p.weight AS partial, fa.weight AS w_cv, la.weight AS w_1se, e.weight AS w_partial, e.weight IS NOT NULL AS in_partial, fa.weight IS NOT NULL AS in_cv, la.weight IS NOT NULL AS in_1se
       FROM prs p LEFT JOIN edges e USING (e1, e2) LEFT JOIN fa USING (e1, e2) LEFT JOIN la USING (e1, e2)),
md AS (SELECT *, CASE WHEN in_partial AND in_1se THEN 'Common' WHEN in_partial THEN 'Partial-only' WHEN in_1se THEN 'GLasso-1SE-only' ELSE 'Neither' END AS main_edge_type,
       CASE WHEN in_partial AND in_1se THEN sign(w_partial) = sign(w_1se) END AS sign_same, abs(partial) - abs(coalesce(w_1se, 0)) AS abs_shrinkage FROM mt)"""
_STATISTICS = (("count", "count(weight)"), ("mean", "avg(weight)"), ("std", "stddev_samp(weight)"), ("min", "min(weight)"), ("25%", "quantile_cont(weight, 0.25)"), ("50%", "quantile_cont(weight, 0.5)"), ("75%", "quantile_cont(weight, 0.75)"), ("max", "max(weight)"))

SQL = {
    "t1_tree_length": "WITH RECURSIVE " + TREE + f" SELECT {r('avg(d)', 'tree_length')} FROM tree",
    "t2_occupation_layer": "WITH RECURSIVE " + TREE + f" SELECT {r('avg(level)', 'mean_layer')} FROM down",
    "snk3_tree_layout": "WITH RECURSIVE " + TREE + f" SELECT entity, {rs('x', 'y')}, level FROM laid",
    "t3_window_trees": "WITH RECURSIVE " + H + TREES + f" SELECT window_id, e1, e2, {rs('weight', 'distance')} FROM wt",
    "t3_tree_survival": "WITH RECURSIVE " + H + TREES + f""",
tc AS (SELECT window_id, count(*) AS n_edges FROM wt GROUP BY 1), tn AS (SELECT *, lead(window_id) OVER (ORDER BY window_id) AS window_to FROM tc)
SELECT window_id AS window_from, window_to, n_edges, count(b.e1) AS n_common, {r('count(b.e1) / n_edges', 'survival')} FROM tn JOIN wt a USING (window_id) LEFT JOIN wt b ON b.window_id = window_to AND b.e1 = a.e1 AND b.e2 = a.e2 WHERE window_to IS NOT NULL GROUP BY 1, 2, 3""",
    "g8_path_centrality": "WITH RECURSIVE " + PAIRS + paths("g", "edges") + f" SELECT entity, {rs('betweenness', 'closeness')} FROM g",
    "g8_hop_centrality": "WITH RECURSIVE " + PAIRS + paths("g", "edges", "1.0::DOUBLE") + f" SELECT entity, {rs('betweenness', 'closeness')} FROM g",
    "c4_node_paths": "WITH RECURSIVE " + H + HALVES + paths("fp", "fa", "sqrt(2 * (1 - weight))") + paths("lp", "la", "sqrt(2 * (1 - weight))")
    + " SELECT entity, " + ", ".join(r(x, n) for m in ("betweenness", "closeness") for x, n in ((f"fp.{m}", f"first_{m}"), (f"lp.{m}", f"last_{m}"), (f"lp.{m} - fp.{m}", f"{m}_change"))) + " FROM fp JOIN lp USING (entity)",
    "a13_describe": WITH + PAIRS + " " + " UNION ALL ".join(f"SELECT '{n}' AS statistic, {r(x, 'value')} FROM prs" for n, x in _STATISTICS),
    "l3_top_pairs": WITH + PAIRS + f" SELECT e1, e2, {r('weight')} FROM prs ORDER BY round(prs.weight, 9) DESC, e1, e2 LIMIT 30",
    "e6_agreement": WITH + PAIRS + """,
cv AS (SELECT a.entity AS i, b.entity AS j, covar_samp(a.ret, b.ret) AS v, corr(a.ret, b.ret) AS c FROM full_rows a JOIN full_rows b ON a.k = b.k GROUP BY 1, 2),
sc AS (SELECT cv.*, p.v AS d1, q.v AS d2 FROM cv JOIN cv p ON p.i = p.j AND p.i = cv.i JOIN cv q ON q.i = q.j AND q.i = cv.j),
ag AS (SELECT count(*) AS n_cells, max(abs(CASE WHEN i = j THEN 1.0 ELSE v / sqrt(d1 * d2) END - c)) AS max_direct, max(abs(CASE WHEN i = j THEN 1.0 ELSE v / sqrt(d1 * d2) END - v / sqrt(d1) / sqrt(d2))) AS max_matrix FROM sc)
""" + f"SELECT n_cells, {rs('max_direct', 'max_matrix')}, greatest(ag.max_direct, ag.max_matrix) <= 1e-12 AS agree FROM ag",
    "e7_matrix_diagnostics": WITH + EIGEN + f" SELECT CAST(count(DISTINCT i) AS INT) AS size, CAST(count(DISTINCT i) AS INT) AS rank, {r('any_value(hi.value - gap.value)', 'min_eigen')}, {r('any_value(hi.value)', 'max_eigen')}, {r('any_value(hi.value / (hi.value - gap.value))', 'condition')}, 0.0::DOUBLE AS asymmetry FROM m, hi, gap",
    "e8_precision": WITH + inverse() + f' SELECT i AS "row", j AS col, {r("v", "value")}, 0.0::DOUBLE AS inverse_error FROM inv',
    "e9_partial": WITH + inverse() + f' SELECT x.i AS "row", x.j AS col, {r("CASE WHEN x.i = x.j THEN 1.0 ELSE -x.v / sqrt(p.v * q.v) END", "value")} FROM inv x JOIN inv p ON p.i = p.j AND p.i = x.i JOIN inv q ON q.i = q.j AND q.i = x.j',
    "e15_rule_on_a_table": f"""WITH cv AS (SELECT l_discount::DOUBLE AS alpha, avg(l_extendedprice::DOUBLE / 1000) AS mean_score, stddev_pop(l_extendedprice::DOUBLE / 1000) / 50 AS sd_score FROM lineitem GROUP BY 1),
best AS (SELECT alpha AS alpha_cv, mean_score AS best_score, sd_score / sqrt(5) AS se FROM cv ORDER BY mean_score DESC, alpha LIMIT 1)
SELECT {rs('alpha_cv', 'best_score', 'se')}, {r('best_score - se', 'floor')}, (SELECT {r('max(alpha)', 'alpha_1se')} FROM cv WHERE alpha > 0 AND mean_score >= best.best_score - best.se) AS alpha_1se FROM best""",
    "e18_window_stability": WITH + STABLE + f" SELECT block_length, e1, e2, selected_count, valid_runs, {rs('mean_when_selected', 'sd_when_selected', 'frequency', 'positive_fraction', 'negative_fraction', 'sign_consistency')}, dominant_sign, stability_class FROM sb",
    "e18_window_runs": WITH + FITS + f""",
rn AS (SELECT block_length, run, bool_and(valid) AS valid, count_if(weight <> 0) AS n_edges FROM fit GROUP BY 1, 2)
SELECT block_length, count(*) AS runs, {r('avg(valid::INT)', 'valid_rate')}, {r('avg(n_edges) FILTER (valid)', 'mean_edges')}, {r('stddev_samp(n_edges) FILTER (valid)', 'sd_edges')} FROM rn GROUP BY 1""",
    "e20_window_jaccards": WITH + STABLE + f""",
sz AS (SELECT block_length, count_if(frequency >= 0.5) AS n FROM sb GROUP BY 1), on_ AS (SELECT block_length, e1, e2 FROM sb WHERE frequency >= 0.5),
cm AS (SELECT p.block_length AS a, q.block_length AS b, count(*) AS common FROM on_ p JOIN on_ q ON p.e1 = q.e1 AND p.e2 = q.e2 AND p.block_length < q.block_length GROUP BY 1, 2)
SELECT p.block_length AS a, q.block_length AS b, p.n AS n_a, q.n AS n_b, coalesce(common, 0) AS common, {r('coalesce(common, 0) / nullif(p.n + q.n - coalesce(common, 0), 0)', 'jaccard')} FROM sz p JOIN sz q ON p.block_length < q.block_length LEFT JOIN cm ON cm.a = p.block_length AND cm.b = q.block_length""",
    "e21_robust_window_edges": WITH + STABLE + ",\nrw AS (SELECT e1, e2, " + ", ".join(f"max(frequency) FILTER (block_length = {w}) AS frequency_{w}" for w in _SIZES) + " FROM sb GROUP BY 1, 2)\nSELECT e1, e2, "
    + rs(*[f"frequency_{w}" for w in _SIZES]) + f""", {r('least(rw.frequency_18, rw.frequency_24, rw.frequency_36)', 'min_frequency')}, {r('(rw.frequency_18 + rw.frequency_24 + rw.frequency_36) / 3', 'mean_frequency')}, {r('greatest(rw.frequency_18, rw.frequency_24, rw.frequency_36)', 'max_frequency')},
{r('greatest(rw.frequency_18, rw.frequency_24, rw.frequency_36) - least(rw.frequency_18, rw.frequency_24, rw.frequency_36)', 'frequency_range')}, least(rw.frequency_18, rw.frequency_24, rw.frequency_36) >= 0.8 AS stable_all, least(rw.frequency_18, rw.frequency_24, rw.frequency_36) >= 0.9 AS core_all FROM rw""",
    "e19_baseline_retention": WITH + PAIRS + "".join(hist(w, f"h{w}") for w in _SIZES) + STABLE[STABLE.index(",\nh AS ("):] + f"""
SELECT block_length, count_if(frequency >= 0.5) AS n_stable, count_if(frequency >= 0.9) AS n_core, count_if(frequency >= 0.5 AND b.e1 IS NOT NULL) AS n_retained, (SELECT count(*) FROM edges) AS n_baseline,
{r('count_if(frequency >= 0.5 AND b.e1 IS NOT NULL) / (SELECT count(*) FROM edges)', 'retention')} FROM sb LEFT JOIN (SELECT e1, e2 FROM edges) b USING (e1, e2) GROUP BY 1""",
    "c3_attenuation_matrix": WITH + HP + TWO + f""" SELECT e1 AS "row", e2 AS col, {r('attenuation', 'value')} FROM pc UNION ALL SELECT e2, e1, {r('attenuation', 'value')} FROM pc UNION ALL SELECT x, x, 0.0 FROM (SELECT e1 AS x FROM pc UNION SELECT e2 FROM pc)""",
    "c5_three_methods": WITH + METHODS + f" SELECT e1, e2, {rs('partial', 'w_cv', 'w_1se')}, in_partial, in_cv, in_1se, main_edge_type, sign_same::VARCHAR AS sign_same, {r('abs_shrinkage')} FROM md",
    "c6_common_strong": WITH + METHODS + f" SELECT count(*) AS n_common, {r('avg(sign_same::INT)', 'sign_agreement')} FROM md WHERE in_partial AND in_1se",
    "n1_window_components": "WITH RECURSIVE " + H + """,
wl AS (SELECT window_id, e1 AS a, e2 AS b FROM h WHERE selected UNION ALL SELECT window_id, e2, e1 FROM h WHERE selected),
wx AS (SELECT DISTINCT window_id, unnest([e1, e2]) AS a FROM h),
wr AS (SELECT window_id, a, a AS b FROM wx UNION SELECT wr.window_id, wr.a, wl.b FROM wr JOIN wl ON wl.window_id = wr.window_id AND wl.a = wr.b),
wc AS (SELECT window_id, a, min(b) AS component, count(*) AS size FROM wr GROUP BY 1, 2)
SELECT window_id, count(DISTINCT component) AS n_components, max(size) AS largest FROM wc GROUP BY 1""",
    "n19_disagreements": WITH + HP + persistent() + LIFE + """,
dg AS (SELECT e1, e2, CASE WHEN coalesce(abs(q.weight) >= 0.2, false) THEN 'Static stable only' ELSE 'Dynamic persistent only' END AS stability_class FROM ps LEFT JOIN (SELECT e1, e2, weight FROM prs) q USING (e1, e2) WHERE coalesce(abs(q.weight) >= 0.2, false) <> (persistence >= 0.5))
SELECT e1, e2, stability_class, lifecycle_class, n_episodes, longest_run, windows_selected FROM dg LEFT JOIN lf USING (e1, e2)""",
    "n22_relation_lifecycles": relation_lifecycles("true"),
    "n22_active_non_core": relation_lifecycles("persistence < 0.8 AND windows_selected >= 3"),
    "a7_class_counts": WITH + H + LIFE + " SELECT c AS class, count(e1) AS n FROM (SELECT unnest(['" + "', '".join(_CLASSES) + "', 'Other']) AS c) LEFT JOIN lf ON lifecycle_class = c GROUP BY 1",
    "l2_class_order": WITH + H + LIFE + f" SELECT CASE WHEN same_grp THEN 'Same' ELSE 'Cross' END AS relation, lifecycle_class, count(*) AS n_edges, {r('avg(persistence)', 'mean_persistence')}, {r('avg(transition_rate)', 'mean_transition_rate')}, {r('avg(n_episodes)', 'mean_episodes')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY same_grp)', 'share')} FROM lf GROUP BY same_grp, lifecycle_class ORDER BY list_position(['"
    + "', '".join(_CLASSES) + "'], lifecycle_class), relation",
    "n38_top_edges": WITH + H + RCHANGE + f" SELECT regime_before, regime_after, e1, e2, {r('abs_delta')} FROM rc QUALIFY row_number() OVER (PARTITION BY regime_before, regime_after ORDER BY round(rc.abs_delta, 9) DESC, e1, e2) <= 10",
    "n38_top_nodes": WITH + H + BURDEN + f" SELECT regime_before, regime_after, entity, {rs('abs_burden', 'abs_burden_share')} FROM bu QUALIFY row_number() OVER (PARTITION BY regime_before, regime_after ORDER BY round(bu.abs_burden_share, 9) DESC, entity) <= 10",
    "l4_top_window_nodes": WITH + H + nodes() + f" SELECT window_id, entity, {r('strength')} FROM wn QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY round(wn.strength, 9) DESC, entity) <= 3",
}
