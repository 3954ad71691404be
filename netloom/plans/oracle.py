"""DuckDB SQL of the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations


def r(expression: str, name: str | None = None) -> str:
    """Rounded to 6 digits, without negative zero."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name or expression.split('.')[-1]}"


def rs(*names: str, table: str = "") -> str:
    return ", ".join(r(f"{table}{n}", n) for n in names)


BASE = r"""
sales AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, p_brand AS entity, sum(l_extendedprice) AS value
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
panel AS (SELECT * FROM sales WHERE t < (SELECT max(t) FROM sales)),
dates AS (SELECT t, row_number() OVER (ORDER BY t) AS k FROM (SELECT DISTINCT t FROM panel)),
dim AS (SELECT DISTINCT entity, CAST(CAST(regexp_extract(entity, '(\d+)', 1) AS INT) % 5 AS VARCHAR) AS grp FROM panel),
spine AS (SELECT d.t, d.k, e.entity, CASE WHEN p.value > 0 THEN p.value END AS value
          FROM dates d CROSS JOIN dim e LEFT JOIN panel p ON p.t = d.t AND p.entity = e.entity),
ret0 AS (SELECT t, k, entity, ln(value) - lag(ln(value)) OVER (PARTITION BY entity ORDER BY k) AS ret FROM spine),
ret AS (SELECT * FROM ret0 WHERE k IN (SELECT k FROM ret0 WHERE ret IS NOT NULL)),
full_rows AS (SELECT * FROM ret WHERE k IN (SELECT k FROM ret GROUP BY k HAVING count(ret) = (SELECT count(*) FROM dim)))
"""
PAIRS = BASE + r""",
pearson AS (SELECT a.entity AS e1, b.entity AS e2, count(*) AS n_common,
            CASE WHEN stddev_pop(a.ret) > 1e-12 AND stddev_pop(b.ret) > 1e-12 THEN covar_pop(a.ret, b.ret) / (stddev_pop(a.ret) * stddev_pop(b.ret)) END AS c
            FROM ret a JOIN ret b ON a.k = b.k AND a.entity < b.entity WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
prs AS (SELECT e1, e2, c AS weight FROM pearson WHERE n_common >= 12 AND c IS NOT NULL),
edges AS (SELECT *, sqrt(2 * (1 - weight)) AS distance FROM prs WHERE weight >= 0.2),
inc AS (SELECT e1 AS entity, e2 AS other, weight, distance FROM edges UNION ALL SELECT e2, e1, weight, distance FROM edges),
deg AS (SELECT d.entity, count(i.other) AS degree, coalesce(sum(weight), 0) AS weighted_degree, coalesce(sum(abs(weight)), 0) AS strength, avg(weight) AS mean_weight
        FROM dim d LEFT JOIN inc i ON i.entity = d.entity GROUP BY 1),
grouped AS (SELECT e.*, a.grp AS grp_1, b.grp AS grp_2, a.grp = b.grp AS same_grp FROM edges e JOIN dim a ON a.entity = e1 JOIN dim b ON b.entity = e2)
"""
REACH = r""",
reach AS (SELECT entity, entity AS other FROM dim UNION SELECT reach.entity, inc.other FROM reach JOIN inc ON inc.entity = reach.other),
comp AS (SELECT entity, min(other) AS component FROM reach GROUP BY 1)
"""
MIX = r""",
mix AS (SELECT grp_1 AS x, grp_2 AS y FROM grouped UNION ALL SELECT grp_2, grp_1 FROM grouped),
margin AS (SELECT sum(c * c) AS squares FROM (SELECT count(*) AS c FROM mix GROUP BY x)),
ass AS (SELECT (sum((x = y)::int) / count(*) - (SELECT squares FROM margin) / (count(*) * count(*))) / nullif(1 - (SELECT squares FROM margin) / (count(*) * count(*)), 0) AS assortativity FROM mix)
"""
WITH = "WITH "


def hist(size: int, name: str = "h", step: int = 3) -> str:
    return f""",
ix_{name} AS (SELECT t, k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT t, k FROM ret)),
ends_{name} AS (SELECT i, t, CAST((i - {size - 1}) // {step} + 1 AS INT) AS window_id FROM ix_{name} WHERE i >= {size - 1} AND (i - {size - 1}) % {step} = 0),
ri_{name} AS (SELECT r.entity, r.ret, x.i, x.t FROM ret r JOIN ix_{name} x USING (k)),
sums_{name} AS (
  SELECT w.window_id, min(a.t) AS window_start, w.t AS network_date, w.i AS end_row, a.entity AS e1, b.entity AS e2,
         count(*) FILTER (a.ret + b.ret IS NOT NULL) AS n, sum(a.ret) FILTER (b.ret IS NOT NULL) AS sx, sum(b.ret) FILTER (a.ret IS NOT NULL) AS sy,
         sum(a.ret * a.ret) FILTER (b.ret IS NOT NULL) AS sxx, sum(b.ret * b.ret) FILTER (a.ret IS NOT NULL) AS syy, sum(a.ret * b.ret) AS sxy
  FROM ends_{name} w JOIN ri_{name} a ON a.i BETWEEN w.i - {size - 1} AND w.i JOIN ri_{name} b ON b.i = a.i AND a.entity < b.entity
  GROUP BY 1, 3, 4, 5, 6),
cor_{name} AS (
  SELECT *, CASE WHEN n >= 3 AND sxx - sx * sx / n > 1e-12 AND syy - sy * sy / n > 1e-12
            THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END AS weight FROM sums_{name}),
{name} AS (
  SELECT window_id, window_start, network_date, end_row, e1, e2, weight, coalesce(abs(weight) >= 0.3, false) AS selected, p.grp = q.grp AS same_grp
  FROM cor_{name} JOIN dim p ON p.entity = e1 JOIN dim q ON q.entity = e2)"""


H = BASE + hist(24)
HP = PAIRS + hist(24)


def moves(key: str = "", table: str = "h") -> str:
    k = f"{key}, " if key else ""
    return f""",
lagged AS (SELECT *, lag(selected) OVER (PARTITION BY {k}e1, e2 ORDER BY window_id) AS was, lag(window_id) OVER (PARTITION BY {k}e1, e2 ORDER BY window_id) AS window_from,
           lag(network_date) OVER (PARTITION BY {k}e1, e2 ORDER BY window_id) AS date_from FROM {table}),
tn AS (SELECT {k}window_from, window_id AS window_to, date_from, network_date AS date_to, count_if(was) AS edges_from, count_if(selected) AS edges_to,
       count_if(was AND selected) AS common_edges, count_if(was AND NOT selected) AS lost_edges, count_if(NOT was AND selected) AS gained_edges, count_if(was OR selected) AS union_edges,
       count_if(was AND NOT selected AND same_grp) AS lost_same, count_if(was AND NOT selected AND NOT same_grp) AS lost_cross,
       count_if(NOT was AND selected AND same_grp) AS gained_same, count_if(NOT was AND selected AND NOT same_grp) AS gained_cross
       FROM lagged WHERE was IS NOT NULL GROUP BY ALL),
tv AS (SELECT *, edges_to - edges_from AS net_edge_change, lost_edges + gained_edges AS gross_edge_changes,
       CASE WHEN union_edges = 0 THEN 1.0 ELSE common_edges / union_edges END AS jaccard, 1 - CASE WHEN union_edges = 0 THEN 1.0 ELSE common_edges / union_edges END AS turnover,
       common_edges / nullif(edges_from, 0) AS retention, common_edges / nullif(edges_to, 0) AS inherited_share, lost_edges / nullif(edges_from, 0) AS lost_rate, gained_edges / nullif(edges_to, 0) AS gained_rate,
       lost_same + gained_same AS same_edge_changes, lost_cross + gained_cross AS cross_edge_changes, gained_same - lost_same AS net_same, gained_cross - lost_cross AS net_cross,
       (lost_cross + gained_cross) / nullif(lost_edges + gained_edges, 0) AS cross_change_share FROM tn)"""


def nodes(key: str = "", table: str = "h") -> str:
    k = f"{key}, " if key else ""
    return f""",
hi AS (SELECT {k}window_id, network_date, e1 AS entity, weight, selected, same_grp FROM {table} UNION ALL SELECT {k}window_id, network_date, e2, weight, selected, same_grp FROM {table}),
wn AS (SELECT {k}window_id, network_date, entity, count_if(selected) AS degree, coalesce(sum(abs(weight)) FILTER (selected), 0) AS strength,
       count_if(selected AND same_grp) AS same_degree, count_if(selected AND NOT same_grp) AS cross_degree,
       coalesce(sum(abs(weight)) FILTER (selected AND same_grp), 0) AS same_strength, coalesce(sum(abs(weight)) FILTER (selected AND NOT same_grp), 0) AS cross_strength FROM hi GROUP BY ALL)"""


def states(key: str = "", table: str = "h") -> str:
    k = f"{key}, " if key else ""
    return (
        nodes(key, table)
        + f""",
ws AS (SELECT {k}window_id, window_start, network_date, count_if(selected) AS edge_count, count_if(selected) / count(*) AS density, avg(abs(weight)) FILTER (selected) AS mean_abs_weight,
       median(abs(weight)) FILTER (selected) AS median_abs_weight, coalesce(sum(abs(weight)) FILTER (selected), 0) AS total_abs_weight, count_if(selected AND same_grp) AS same_edges, count_if(selected AND NOT same_grp) AS cross_edges,
       avg(abs(weight)) FILTER (selected AND same_grp) AS mean_abs_same, avg(abs(weight)) FILTER (selected AND NOT same_grp) AS mean_abs_cross,
       median(abs(weight)) FILTER (selected AND same_grp) AS median_abs_same, median(abs(weight)) FILTER (selected AND NOT same_grp) AS median_abs_cross,
       count_if(selected AND weight > 0) AS positive_edges, count_if(selected AND weight < 0) AS negative_edges FROM {table} GROUP BY ALL),
st AS (SELECT ws.*, same_edges / nullif(edge_count, 0) AS same_ratio, cross_edges / nullif(edge_count, 0) AS cross_ratio, mean_degree, max_degree, n_isolated
       FROM ws JOIN (SELECT {k}window_id, avg(degree) AS mean_degree, max(degree) AS max_degree, count_if(degree = 0) AS n_isolated FROM wn GROUP BY ALL) USING ({k}window_id))"""
    )


def persistent(key: str = "", table: str = "h") -> str:
    k = f"{key}, " if key else ""
    return f""",
ps AS (SELECT {k}e1, e2, same_grp, count_if(selected) AS windows_selected, count(*) AS total_windows, avg(weight) AS mean_weight, avg(abs(weight)) AS mean_abs_weight,
       avg(weight) FILTER (selected) AS mean_when_selected, avg(abs(weight)) FILTER (selected) AS mean_abs_when_selected, min(network_date) FILTER (selected) AS first_selected,
       max(network_date) FILTER (selected) AS last_selected, count_if(selected) / count(*) AS persistence FROM {table} GROUP BY ALL),
pb AS (SELECT {k}CASE WHEN same_grp THEN 'Same' ELSE 'Cross' END AS relation, count(*) AS n_pairs, avg(persistence) AS mean_persistence, median(persistence) AS median_persistence,
       count_if(persistence >= 0.8) AS n_persistent, count_if(persistence >= 0.99998) AS n_always, avg(mean_abs_when_selected) AS mean_strength,
       count_if(persistence >= 0.8) / count(*) AS persistent_share, count_if(persistence >= 0.99998) / count(*) AS always_share FROM ps GROUP BY ALL)"""


SCALES = BASE + "".join(hist(w, f"h{w}") for w in (18, 24, 36)) + ",\nh AS (" + " UNION ALL ".join(f"SELECT {w} AS window_size, * EXCLUDE (window_id, end_row), end_row AS window_id FROM h{w} WHERE end_row >= 35" for w in (18, 24, 36)) + ")"
SIZE = "window_size"
RATES = """,
rt AS (SELECT window_size, CASE WHEN same_grp THEN 'Same' ELSE 'Cross' END AS relation, count(DISTINCT (e1, e2)) AS n_pairs, count(DISTINCT network_date) AS n_windows,
       count_if(was <> selected) AS state_changes, count_if(NOT was AND selected) AS entries, count_if(was AND NOT selected) AS exits, count_if(was) AS selected_exposures, count_if(NOT was) AS absent_exposures, count_if(selected) AS ons
       FROM lagged GROUP BY ALL),
rates AS (SELECT *, n_pairs * (n_windows - 1) AS opportunities, state_changes / nullif(n_pairs * (n_windows - 1), 0) AS state_change_rate, entries / nullif(absent_exposures, 0) AS entry_rate,
       exits / nullif(selected_exposures, 0) AS exit_rate, ons / n_windows AS average_edges, state_changes / nullif(sum(state_changes) OVER (PARTITION BY window_size), 0) AS share_of_changes FROM rt)"""
MULTI = """,
wide AS (SELECT e1, e2, same_grp, max(persistence) FILTER (window_size = 18) AS persistence_18, max(persistence) FILTER (window_size = 24) AS persistence_24, max(persistence) FILTER (window_size = 36) AS persistence_36 FROM ps GROUP BY ALL),
ms0 AS (SELECT *, least(persistence_18, persistence_24, persistence_36) AS min_persistence, (persistence_18 + persistence_24 + persistence_36) / 3 AS mean_persistence, greatest(persistence_18, persistence_24, persistence_36) AS max_persistence,
        (persistence_18 >= 0.8)::int + (persistence_24 >= 0.8)::int + (persistence_36 >= 0.8)::int AS n_scales FROM wide),
ms AS (SELECT *, sqrt(((persistence_18 - mean_persistence) ** 2 + (persistence_24 - mean_persistence) ** 2 + (persistence_36 - mean_persistence) ** 2) / 3) AS sd_persistence, max_persistence - min_persistence AS range_persistence,
       n_scales = 3 AS persistent_all, min_persistence >= 0.99998 AS always_all, n_scales IN (1, 2) AS scale_dependent,
       CASE WHEN abs(persistence_18 - persistence_24) <= 1e-12 AND abs(persistence_24 - persistence_36) <= 1e-12 THEN 'Constant' WHEN persistence_18 <= persistence_24 + 1e-12 AND persistence_24 <= persistence_36 + 1e-12 THEN 'Non-decreasing with W'
            WHEN persistence_18 >= persistence_24 - 1e-12 AND persistence_24 >= persistence_36 - 1e-12 THEN 'Non-increasing with W' ELSE 'Non-monotonic' END AS pattern,
       CASE WHEN min_persistence >= 0.99998 THEN 'Always persistent at all scales' WHEN n_scales = 3 THEN 'Multi-scale persistent' WHEN n_scales = 2 THEN 'Persistent at 2 scales' WHEN n_scales = 1 THEN 'Persistent at 1 scale' ELSE 'Not persistent at any scale' END AS core_class FROM ms0)"""
CONTRAST = """,
ct0 AS (SELECT window_size, """ + ", ".join(f"max({m}) FILTER (relation = '{k}') AS {k.lower()}_{m}" for m in ("mean_persistence", "persistent_share", "always_share", "state_change_rate", "entry_rate", "exit_rate") for k in ("Same", "Cross")) + """,
        max(share_of_changes) FILTER (relation = 'Cross') AS cross_share_of_changes FROM pb JOIN rates USING (window_size, relation) GROUP BY 1),
ct AS (SELECT *, same_mean_persistence - cross_mean_persistence AS persistence_difference, CASE WHEN abs(cross_mean_persistence) > 1e-12 THEN same_mean_persistence / cross_mean_persistence END AS persistence_ratio,
       CASE WHEN abs(cross_persistent_share) > 1e-12 THEN same_persistent_share / cross_persistent_share END AS persistent_ratio, CASE WHEN abs(cross_always_share) > 1e-12 THEN same_always_share / cross_always_share END AS always_ratio,
       CASE WHEN abs(same_state_change_rate) > 1e-12 THEN cross_state_change_rate / same_state_change_rate END AS change_ratio, CASE WHEN abs(same_exit_rate) > 1e-12 THEN cross_exit_rate / same_exit_rate END AS exit_ratio FROM ct0)"""
MULTI_SUMS = "count(*) AS n_pairs, count_if(persistent_all) AS n_multi_scale, count_if(always_all) AS n_always, count_if(scale_dependent) AS n_scale_dependent, " + ", ".join([r("avg(min_persistence)", "mean_min_persistence"), r("median(min_persistence)", "median_min_persistence"), r("avg(range_persistence)", "mean_range"), r("max(range_persistence)", "max_range"), r("count_if(persistent_all) / count(*)", "multi_scale_rate"), r("count_if(always_all) / count(*)", "always_rate")])


def ranked(top: int) -> str:
    return (
        nodes()
        + f""",
rk0 AS (SELECT * REPLACE (round(strength, 9) AS strength) FROM wn),
rk1 AS (SELECT *, rank() OVER (PARTITION BY window_id ORDER BY degree DESC) + (count(*) OVER (PARTITION BY window_id, degree) - 1) / 2 AS degree_rank,
        rank() OVER (PARTITION BY window_id ORDER BY strength DESC) + (count(*) OVER (PARTITION BY window_id, strength) - 1) / 2 AS strength_rank FROM rk0),
rk AS (SELECT *, degree_rank <= {top} AS top_degree, strength_rank <= {top} AS top_strength FROM rk1)"""
    )


_MOMENTS = [(c, f, n) for c in ("degree", "strength", "degree_rank", "strength_rank") for f, n in (("avg", "mean"), ("stddev_samp", "sd"), ("min", "min"), ("max", "max"))]
STABLE = ranked(8) + """,
cs0 AS (SELECT entity, count(*) AS n_windows, """ + ", ".join(f"{f}({c}) AS {n}_{c}" for c, f, n in _MOMENTS) + """, avg(top_degree::int) AS top_degree_share, avg(top_strength::int) AS top_strength_share,
        CASE WHEN stddev_pop(degree) > 1e-12 AND stddev_pop(strength) > 1e-12 THEN covar_pop(degree, strength) / (stddev_pop(degree) * stddev_pop(strength)) END AS degree_strength_corr FROM rk GROUP BY 1),
cs AS (SELECT *, """ + ", ".join(f"max_{c} - min_{c} AS range_{c}" for c in ("degree", "strength", "degree_rank", "strength_rank")) + """,
       CASE WHEN abs(mean_degree) >= 1e-12 THEN sd_degree / abs(mean_degree) END AS cv_degree, CASE WHEN abs(mean_strength) >= 1e-12 THEN sd_strength / abs(mean_strength) END AS cv_strength FROM cs0)"""
_STABLE_COLS = [f"{n}_{c}" for c, _, n in _MOMENTS] + [f"range_{c}" for c in ("degree", "strength", "degree_rank", "strength_rank")] + ["top_degree_share", "top_strength_share", "degree_strength_corr", "cv_degree", "cv_strength"]
EPISODES = """,
ep0 AS (SELECT *, row_number() OVER (PARTITION BY e1, e2 ORDER BY window_id) AS place FROM h),
ep1 AS (SELECT *, place - row_number() OVER (PARTITION BY e1, e2 ORDER BY window_id) AS run FROM ep0 WHERE selected),
ep2 AS (SELECT e1, e2, same_grp, run, min(window_id) AS start_window, max(window_id) AS end_window, min(network_date) AS start_date, max(network_date) AS end_date, count(*) AS length FROM ep1 GROUP BY ALL),
ep AS (SELECT * EXCLUDE (run), row_number() OVER (PARTITION BY e1, e2 ORDER BY start_window) AS episode FROM ep2)"""
LIFE = moves() + EPISODES + """,
lf0 AS (SELECT e1, e2, same_grp, count(*) AS total_windows, count_if(selected) AS windows_selected, count_if(was <> selected) AS switch_count, count_if(NOT was AND selected) AS entry_count, count_if(was AND NOT selected) AS exit_count,
        min(network_date) FILTER (selected) AS first_selected, max(network_date) FILTER (selected) AS last_selected, avg(weight) FILTER (selected) AS mean_when_selected, avg(abs(weight)) FILTER (selected) AS mean_abs_when_selected,
        max(abs(weight)) FILTER (selected) AS max_abs_when_selected, greatest(count_if(selected AND weight > 0), count_if(selected AND weight < 0)) AS signs, string_agg(selected::int::varchar, '' ORDER BY window_id) AS selection_sequence FROM lagged GROUP BY ALL),
lr AS (SELECT e1, e2, count(*) AS n_episodes, max(length) AS longest_run, avg(length) AS mean_episode_length, first(start_date ORDER BY length DESC, start_window) AS longest_run_start, first(end_date ORDER BY length DESC, start_window) AS longest_run_end FROM ep GROUP BY ALL),
lf1 AS (SELECT lf0.*, coalesce(n_episodes, 0) AS n_episodes, coalesce(longest_run, 0) AS longest_run, mean_episode_length, longest_run_start, longest_run_end, windows_selected / total_windows AS persistence,
        coalesce(longest_run, 0) / nullif(windows_selected, 0) AS longest_run_share, switch_count / nullif(total_windows - 1, 0) AS transition_rate, signs / nullif(windows_selected, 0) AS sign_consistency FROM lf0 LEFT JOIN lr USING (e1, e2)),
lf AS (SELECT * EXCLUDE (signs), CASE WHEN persistence >= 0.8 THEN 'Persistent core' WHEN windows_selected <= 2 THEN 'Rare' WHEN n_episodes = 1 AND longest_run >= 3 THEN 'Regime-dependent'
       WHEN n_episodes >= 3 THEN 'Intermittent' WHEN n_episodes = 2 THEN 'Two-episode transitional' ELSE 'Other' END AS lifecycle_class FROM lf1)"""

_ZS = ("edge_count", "density", "mean_abs_weight", "same_edges", "cross_edges", "same_ratio", "turnover", "gross_edge_changes")
_MOVES = ("net_edge_change", "common_edges", "lost_edges", "gained_edges", "gross_edge_changes", "jaccard", "turnover", "lost_same", "gained_same", "lost_cross", "gained_cross", "same_edge_changes", "cross_edge_changes", "cross_change_share")


def z(c: str) -> str:
    return f"CASE WHEN stddev_samp({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END AS {c}_z"


STATE = states() + moves() + f""",
s0 AS (SELECT st.*, {", ".join("tv." + c for c in _MOVES)} FROM st LEFT JOIN tv ON tv.date_to = st.network_date),
s1 AS (SELECT *, {", ".join(z(c) for c in _ZS)} FROM s0),
s AS (SELECT *, coalesce(turnover_z > 1.0, false) AS high_turnover_z1, coalesce(turnover_z > 1.5, false) AS high_turnover_z1_5, coalesce(gross_edge_changes_z > 1.0, false) AS high_change_z1 FROM s1)"""
SCORE = STATE + f""",
c0 AS (SELECT window_id, network_date, turnover, gross_edge_changes, net_edge_change, cross_edge_changes, cross_change_share, CASE WHEN gross_edge_changes > 0 THEN 2 * least(lost_edges, gained_edges) / gross_edge_changes ELSE 0.0 END AS rewiring_share,
       abs(net_edge_change) AS abs_edge_count_change, {", ".join(f"{c} - lag({c}) OVER (ORDER BY network_date) AS delta_{c}" for c in ("same_edges", "cross_edges", "mean_abs_weight", "same_ratio"))} FROM s),
c1 AS (SELECT *, {", ".join(z(c) for c in ("turnover", "gross_edge_changes", "abs_edge_count_change", "cross_edge_changes"))} FROM c0),
mid AS (SELECT median(turnover) AS mt, median(gross_edge_changes) AS mg FROM c0),
mad AS (SELECT median(abs(turnover - mt)) AS dt, median(abs(gross_edge_changes - mg)) AS dg FROM c0, mid),
c2 AS (SELECT c1.*, CASE WHEN dt > 1e-12 THEN 0.6745 * (turnover - mt) / dt END AS turnover_robust_z, CASE WHEN dg > 1e-12 THEN 0.6745 * (gross_edge_changes - mg) / dg END AS gross_edge_changes_robust_z FROM c1, mid, mad),
c AS (SELECT *, 0.5 * turnover_z + 0.5 * gross_edge_changes_z AS core_change_score, greatest(turnover_z, gross_edge_changes_z) AS max_core_z, coalesce(turnover_z >= 1 AND gross_edge_changes_z >= 1, false) AS high_change_joint,
      coalesce(turnover_robust_z >= 1.5, false) AS robust_high_turnover, coalesce(gross_edge_changes_robust_z >= 1.5, false) AS robust_high_gross_change,
      CASE WHEN gross_edge_changes IS NULL THEN 'Initial network' WHEN gross_edge_changes = 0 THEN 'Stable support' WHEN rewiring_share >= 0.6 AND net_edge_change > 0 THEN 'Rewiring with expansion'
           WHEN rewiring_share >= 0.6 AND net_edge_change < 0 THEN 'Rewiring with contraction' WHEN rewiring_share >= 0.6 THEN 'Pure rewiring' WHEN net_edge_change > 0 THEN 'Expansion-dominant' WHEN net_edge_change < 0 THEN 'Contraction-dominant' ELSE 'Balanced structural change' END AS change_type,
      CASE WHEN cross_change_share IS NULL THEN 'No change' WHEN cross_change_share >= 0.8 THEN 'Cross-industry dominated' WHEN cross_change_share <= 0.2 THEN 'Same-industry dominated' ELSE 'Mixed' END AS change_source,
      coalesce(greatest(turnover_z, gross_edge_changes_z) >= 1, false) AS high_change_moderate, coalesce(greatest(turnover_z, gross_edge_changes_z) >= 1.5, false) AS high_change_strong, coalesce(greatest(turnover_z, gross_edge_changes_z) >= 2, false) AS high_change_very_strong FROM c2)"""

#: Regimes: every cut set of up to five segments of at least three windows is priced, and the cheapest criterion wins.
_FEATURES = ("same_edges", "cross_edges", "mean_abs_weight")
REGIME = STATE + f""",
fz AS (SELECT row_number() OVER (ORDER BY network_date) AS i, {", ".join(f"CASE WHEN stddev_samp({f}) OVER () > 1e-12 THEN ({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () ELSE 0 END AS f{j}" for j, f in enumerate(_FEATURES))} FROM s),
nn AS (SELECT count(*) AS n FROM fz),
seg AS (SELECT a.i - 1 AS lo, b.i AS hi, greatest(sum(x.f0 * x.f0 + x.f1 * x.f1 + x.f2 * x.f2) - (sum(x.f0) ** 2 + sum(x.f1) ** 2 + sum(x.f2) ** 2) / count(*), 0) AS cost
        FROM fz a JOIN fz b ON b.i - a.i >= 2 JOIN fz x ON x.i BETWEEN a.i AND b.i GROUP BY 1, 2),
r1 AS (SELECT 1 AS rr, hi, cost, [hi] AS ends FROM seg WHERE lo = 0),
r2 AS (SELECT 2 AS rr, seg.hi, r1.cost + seg.cost AS cost, list_append(ends, seg.hi) AS ends FROM r1 JOIN seg ON seg.lo = r1.hi),
r3 AS (SELECT 3 AS rr, seg.hi, r2.cost + seg.cost AS cost, list_append(ends, seg.hi) AS ends FROM r2 JOIN seg ON seg.lo = r2.hi),
r4 AS (SELECT 4 AS rr, seg.hi, r3.cost + seg.cost AS cost, list_append(ends, seg.hi) AS ends FROM r3 JOIN seg ON seg.lo = r3.hi),
r5 AS (SELECT 5 AS rr, seg.hi, r4.cost + seg.cost AS cost, list_append(ends, seg.hi) AS ends FROM r4 JOIN seg ON seg.lo = r4.hi),
cuts AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5),
best AS (SELECT rr AS n_regimes, cost AS rss, ends, n * 3 * ln(greatest(cost, 1e-12) / (n * 3)) + (rr * 3 + rr - 1) * ln(n) AS bic_style FROM cuts, nn WHERE hi = n ORDER BY bic_style, rr LIMIT 1),
rg AS (SELECT s.window_id, s.network_date, CAST(1 + len(list_filter(ends, lambda e: e < s.i)) AS INT) AS regime, CAST(n_regimes AS INT) AS n_regimes, rss, bic_style FROM (SELECT *, row_number() OVER (ORDER BY network_date) AS i FROM s) s, best)"""
_RSUM = [("avg(edge_count)", "mean_edge_count"), ("avg(same_edges)", "mean_same_edges"), ("avg(cross_edges)", "mean_cross_edges"), ("avg(same_ratio)", "mean_same_ratio"), ("avg(mean_abs_weight)", "mean_abs_weight"), ("avg(turnover) FILTER (inside)", "mean_within_turnover"), ("stddev_samp(edge_count)", "sd_edge_count"), ("stddev_samp(cross_edges)", "sd_cross_edges"), ("stddev_samp(mean_abs_weight)", "sd_mean_abs_weight")]
RSUM = REGIME + """,
rin AS (SELECT s.*, rg.regime, lag(rg.regime) OVER (ORDER BY s.network_date) = rg.regime AS inside FROM s JOIN rg USING (window_id)),
rsum AS (SELECT regime, min(network_date) AS start_date, max(network_date) AS end_date, count(*) AS n_networks, """ + ", ".join(f"{e} AS {n}" for e, n in _RSUM) + " FROM rin GROUP BY 1)"
RPERS = RSUM + """,
rp0 AS (SELECT regime, e1, e2, same_grp, count(*) AS n_windows, count_if(selected) AS windows_selected, avg(weight) FILTER (selected) AS mean_when_selected, avg(abs(weight)) FILTER (selected) AS mean_abs_when_selected, max(abs(weight)) FILTER (selected) AS max_abs_when_selected
        FROM h JOIN rg USING (window_id) GROUP BY ALL),
rp AS (SELECT *, windows_selected / n_windows AS persistence, windows_selected / n_windows >= 0.8 AS is_core, windows_selected / n_windows >= 0.99998 AS is_always FROM rp0)"""
RCHANGE = RPERS + """,
rc AS (SELECT a.e1, a.e2, a.same_grp, a.regime AS regime_before, a.persistence AS persistence_before, a.is_core AS core_before, a.is_always AS always_before, b.regime AS regime_after, b.persistence AS persistence_after, b.is_core AS core_after, b.is_always AS always_after,
       b.persistence - a.persistence AS delta_persistence, abs(b.persistence - a.persistence) AS abs_delta,
       CASE WHEN a.is_core AND b.is_core THEN 'Persistent core' WHEN a.is_core THEN 'Lost core' WHEN b.is_core THEN 'Gained core' ELSE 'Non-core both' END AS core_transition
       FROM rp a JOIN rp b ON a.e1 = b.e1 AND a.e2 = b.e2 AND b.regime = a.regime + 1)"""
BURDEN = RCHANGE + """,
bi AS (SELECT *, e1 AS entity FROM rc UNION ALL SELECT *, e2 FROM rc),
bu0 AS (SELECT regime_before, regime_after, entity, count_if(core_transition = 'Lost core') AS lost_core_incident, count_if(core_transition = 'Gained core') AS gained_core_incident,
        count_if(core_transition = 'Lost core' AND same_grp) AS lost_same_core_incident, count_if(core_transition = 'Lost core' AND NOT same_grp) AS lost_cross_core_incident,
        count_if(core_transition = 'Gained core' AND same_grp) AS gained_same_core_incident, count_if(core_transition = 'Gained core' AND NOT same_grp) AS gained_cross_core_incident,
        sum(greatest(-delta_persistence, 0)) AS drop_burden, sum(greatest(delta_persistence, 0)) AS gain_burden, sum(abs_delta) AS abs_burden,
        sum(CASE WHEN same_grp THEN 0 ELSE greatest(-delta_persistence, 0) END) AS cross_drop_burden, sum(CASE WHEN same_grp THEN 0 ELSE greatest(delta_persistence, 0) END) AS cross_gain_burden, sum(CASE WHEN same_grp THEN 0 ELSE abs_delta END) AS cross_abs_burden,
        count_if(delta_persistence <= -0.5) AS major_drop_count, count_if(delta_persistence >= 0.5) AS major_gain_count FROM bi GROUP BY ALL),
bu AS (SELECT *, lost_core_incident + gained_core_incident AS total_core_change, gained_core_incident - lost_core_incident AS net_core_change, gain_burden - drop_burden AS net_shift,
       abs_burden / nullif(sum(abs_burden) OVER (PARTITION BY regime_before, regime_after), 0) AS abs_burden_share, cross_abs_burden / nullif(abs_burden, 0) AS cross_burden_ratio,
       (lost_core_incident + gained_core_incident) / nullif(sum(lost_core_incident + gained_core_incident) OVER (PARTITION BY regime_before, regime_after), 0) AS core_change_share FROM bu0)"""
_NODE = ("degree", "strength", "same_degree", "cross_degree", "same_strength", "cross_strength", "degree_rank", "strength_rank")


def rnodes(start: str) -> str:
    return start + ranked(5).replace(nodes(), "", 1) + ",\nrn AS (SELECT regime, entity, count(*) AS n_networks, " + ", ".join(f"avg({c}) AS mean_{c}" for c in _NODE) + ", stddev_samp(degree) AS sd_degree, stddev_samp(strength) AS sd_strength, avg(top_degree::int) AS top_degree_share, avg(top_strength::int) AS top_strength_share FROM rk JOIN rg USING (window_id) GROUP BY ALL)"


_PART = [f"mean_{m}_{x}" for m in ("degree", "strength", "degree_rank", "strength_rank") for x in ("before", "after")]
NCHANGE = ",\nnc AS (SELECT a.regime AS regime_before, b.regime AS regime_after, a.entity, " + ", ".join(f"{t}.mean_{m} AS mean_{m}_{x}" for m in ("degree", "strength", "degree_rank", "strength_rank") for t, x in (("a", "before"), ("b", "after"))) + ", " + ", ".join(f"b.mean_{m} - a.mean_{m} AS delta_mean_{m}" for m in _NODE[:6]) + """,
 a.mean_degree_rank - b.mean_degree_rank AS degree_rank_improvement, a.mean_strength_rank - b.mean_strength_rank AS strength_rank_improvement, b.top_degree_share - a.top_degree_share AS delta_top_degree_share, b.top_strength_share - a.top_strength_share AS delta_top_strength_share,
 sqrt((a.mean_degree_rank - b.mean_degree_rank) ** 2 + (a.mean_strength_rank - b.mean_strength_rank) ** 2) AS rank_shift FROM rn a JOIN rn b ON a.entity = b.entity AND b.regime = a.regime + 1)"""
_NC = [*_PART, *[f"delta_mean_{m}" for m in _NODE[:6]], "degree_rank_improvement", "strength_rank_improvement", "delta_top_degree_share", "delta_top_strength_share", "rank_shift"]
_BU_INT = ["lost_core_incident", "gained_core_incident", "lost_same_core_incident", "lost_cross_core_incident", "gained_same_core_incident", "gained_cross_core_incident", "major_drop_count", "major_gain_count", "total_core_change", "net_core_change"]
_BU_NUM = ["drop_burden", "gain_burden", "abs_burden", "cross_drop_burden", "cross_gain_burden", "cross_abs_burden", "net_shift", "abs_burden_share", "cross_burden_ratio", "core_change_share"]
HALVES = """,
fa AS (SELECT e1, e2, weight FROM h WHERE selected AND window_id = 1),
la AS (SELECT e1, e2, weight FROM h WHERE selected AND window_id = (SELECT max(window_id) FROM h WHERE selected)),
es AS (SELECT e1, e2, fa.weight AS weight_a, la.weight AS weight_b, CASE WHEN fa.weight IS NOT NULL AND la.weight IS NOT NULL THEN 'Both' WHEN fa.weight IS NOT NULL THEN 'First only' ELSE 'Last only' END AS status FROM fa FULL JOIN la USING (e1, e2))"""
TWO = """,
tw AS (SELECT p.e1, p.e2, p.weight AS pearson, l.weight AS partial FROM prs p JOIN h l ON l.e1 = p.e1 AND l.e2 = p.e2 AND l.window_id = (SELECT max(window_id) FROM h) WHERE l.weight IS NOT NULL),
pc AS (SELECT *, abs(pearson) AS abs_pearson, abs(partial) AS abs_partial, partial - pearson AS signed_change, abs(pearson) - abs(partial) AS attenuation, CASE WHEN abs(pearson) > 1e-12 THEN abs(partial) / abs(pearson) END AS retention_ratio,
       sign(pearson) * sign(partial) < 0 AS sign_flip, sign(pearson) * sign(partial) < 0 AND abs(pearson) >= 0.05 AND abs(partial) >= 0.05 AS meaningful_sign_flip,
       CASE WHEN abs(pearson) >= 0.5 AND abs(partial) <= 0.05 THEN 'Pearson强相关基本消失' WHEN sign(pearson) * sign(partial) < 0 AND abs(pearson) >= 0.05 AND abs(partial) >= 0.05 THEN '条件关系符号反转'
            WHEN abs(pearson) >= 0.5 AND abs(partial) >= 0.2 THEN '强相关仍部分保留' WHEN abs(pearson) >= 0.5 THEN '强相关明显减弱' WHEN abs(partial) > abs(pearson) THEN '控制后关联增强' ELSE '其他' END AS relation_type FROM tw)"""
_PC = ("pearson", "partial", "abs_pearson", "abs_partial", "signed_change", "attenuation", "retention_ratio")
_TV_INT = "window_from, window_to, date_from, date_to, edges_from, edges_to, common_edges, lost_edges, gained_edges, union_edges, lost_same, lost_cross, gained_same, gained_cross, net_edge_change, gross_edge_changes, same_edge_changes, cross_edge_changes, net_same, net_cross"
_ST_INT = "window_id, window_start, network_date, edge_count, same_edges, cross_edges, positive_edges, negative_edges, max_degree, n_isolated"
_ST_NUM = ("density", "mean_abs_weight", "median_abs_weight", "total_abs_weight", "mean_abs_same", "mean_abs_cross", "median_abs_same", "median_abs_cross", "same_ratio", "cross_ratio", "mean_degree")
_PS = "e1, e2, same_grp, windows_selected, total_windows, first_selected, last_selected, " + rs("mean_weight", "mean_abs_weight", "mean_when_selected", "mean_abs_when_selected", "persistence")
_PAIRS_OF_WINDOWS = """,
wp AS (SELECT * FROM (VALUES (1, 2), (2, 5), (1, 10)) v(window_a, window_b)),
wa AS (SELECT window_a, window_b, e1, e2 FROM wp JOIN h ON window_id = window_a AND selected),
wb AS (SELECT window_a, window_b, e1, e2 FROM wp JOIN h ON window_id = window_b AND selected),
wc AS (SELECT window_a, window_b, e1, e2, CASE WHEN wa.e1 IS NOT NULL AND wb.e1 IS NOT NULL THEN 'common' WHEN wa.e1 IS NOT NULL THEN 'lost' ELSE 'gained' END AS change FROM wa FULL JOIN wb USING (window_a, window_b, e1, e2))"""


def sensitivity(value: str) -> str:
    return WITH + PAIRS + " SELECT t AS threshold, " + f"count_if({value} >= t) AS n_edges, {r(f'count_if({value} >= t) / count(*)', 'density')} FROM prs, (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3), (0.4)) v(t) GROUP BY t"


SQL = {
    "pf8_quality_profile": WITH + BASE + f" SELECT entity, count(value) AS n_obs, min(t) FILTER (value IS NOT NULL) AS first_date, max(t) FILTER (value IS NOT NULL) AS last_date, count(*) - count(value) AS n_missing, {r('count(value) / count(*)', 'coverage')} FROM spine GROUP BY 1",
    "pf7_coverage_filter": WITH + BASE + f" SELECT t, entity, {r('value')} FROM spine WHERE entity IN (SELECT entity FROM spine GROUP BY 1 HAVING count(value) / count(*) >= 0.95)",
    "src2_last_per_date": f"SELECT entity, t, {r('value')}, seq FROM (SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS t, o_totalprice AS value, o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "src_event_panel": f"SELECT CAST(ts AS DATE) AS t, event_type AS entity, {r('sum(value)', 'value')} FROM events GROUP BY 1, 2",
    "e1_log_returns": WITH + BASE + f" SELECT t, entity, {r('ret')} FROM ret",
    "e2_return_summary": WITH + BASE + f" SELECT entity, count(ret) AS n_obs, {r('avg(ret)', 'mean_ret')}, {r('stddev_samp(ret)', 'sd_ret')}, {r('stddev_samp(ret) * sqrt(12)', 'annual_volatility')}, {r('min(ret)', 'min_ret')}, {r('max(ret)', 'max_ret')} FROM ret GROUP BY 1",
    "e3_joint_counts": WITH + BASE + " SELECT a.entity AS e1, b.entity AS e2, count(*) FILTER (a.ret IS NOT NULL AND b.ret IS NOT NULL) AS n_common FROM ret a JOIN ret b ON a.k = b.k GROUP BY 1, 2",
    "e4_pearson": WITH + PAIRS + f" SELECT e1, e2, {r('CASE WHEN n_common >= 12 THEN c END', 'corr')}, n_common FROM pearson",
    "e5_covariance": WITH + BASE + f' SELECT a.entity AS "row", b.entity AS col, {r("covar_samp(a.ret, b.ret)", "value")} FROM full_rows a JOIN full_rows b ON a.k = b.k GROUP BY 1, 2',
    "e6_correlation": WITH + BASE + f' SELECT a.entity AS "row", b.entity AS col, {r("CASE WHEN a.entity = b.entity THEN 1.0 ELSE covar_samp(a.ret, b.ret) / sqrt(var_samp(a.ret) * var_samp(b.ret)) END", "value")} FROM full_rows a JOIN full_rows b ON a.k = b.k GROUP BY a.entity, b.entity',
    "e10_standardize": WITH + BASE + f" SELECT t, entity, {r('(ret - avg(ret) OVER (PARTITION BY entity)) / stddev_pop(ret) OVER (PARTITION BY entity)', 'z')} FROM ret WHERE ret IS NOT NULL",
    "pf5_complete_rows": WITH + BASE + f" SELECT t, entity, {r('ret')} FROM full_rows",
    "g1_threshold_edges": WITH + PAIRS + f" SELECT e1, e2, {rs('weight', 'distance')} FROM edges",
    "g2_threshold_sensitivity": sensitivity("weight"),
    "g2_absolute_sensitivity": sensitivity("abs(weight)"),
    "g3_distance_graph": WITH + PAIRS + f" SELECT e1, e2, {r('weight')}, {r('sqrt(2 * (1 - weight))', 'distance')} FROM prs",
    "g5_node_degrees": WITH + PAIRS + f" SELECT entity, degree, {r('degree / (SELECT count(*) - 1 FROM dim)', 'degree_centrality')}, {rs('weighted_degree', 'strength', 'mean_weight')}, degree = 0 AS isolated, degree = 1 AS leaf FROM deg",
    "g10_components": "WITH RECURSIVE " + PAIRS + REACH + " SELECT entity, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp",
    "g14_network_summary": "WITH RECURSIVE " + PAIRS + REACH + MIX + f" SELECT count(*) AS n_nodes, CAST(sum(degree) // 2 AS BIGINT) AS n_edges, {r('avg(degree)', 'mean_degree')}, max(degree) AS max_degree, count(DISTINCT component) AS n_components, count_if(degree = 0) AS n_isolated, {r('sum(degree) / nullif(count(*) * (count(*) - 1), 0)', 'density')}, (SELECT count_if(same_grp) FROM grouped) AS same_edges, {r('(SELECT avg(same_grp::int) FROM grouped)', 'same_ratio')}, {r('(SELECT assortativity FROM ass)', 'assortativity')} FROM deg JOIN comp USING (entity)",
    "g16_assortativity": WITH + PAIRS + MIX + f" SELECT {r('assortativity')} FROM ass",
    "g17_edge_groups": WITH + PAIRS + f" SELECT e1, e2, {rs('weight', 'distance')}, grp_1, grp_2, same_grp, CASE WHEN weight > 0 THEN 'positive' ELSE 'negative' END AS sign FROM grouped",
    "g19_union_graph": WITH + H + f" SELECT e1, e2, {r('avg(weight)', 'weight')}, count(*) AS n_windows FROM h WHERE selected GROUP BY 1, 2",
    "g20_common_graph": WITH + H + f" SELECT e1, e2, {r('avg(weight)', 'weight')} FROM h WHERE selected AND window_id IN (1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 3",
    # an edge is in the tree if no other path has only shorter edges; distances differ, so the tree is unique
    "g4_spanning_tree": "WITH RECURSIVE " + PAIRS + """,
dist AS (SELECT *, sqrt(2 * (1 - weight)) AS distance FROM prs), ranked_edges AS (SELECT *, row_number() OVER (ORDER BY distance, e1, e2) AS n FROM dist),
both_ways AS (SELECT e1 AS a, e2 AS b, n FROM ranked_edges UNION ALL SELECT e2, e1, n FROM ranked_edges),
walk AS (SELECT n AS edge, e1 AS at FROM ranked_edges UNION SELECT walk.edge, both_ways.b FROM walk JOIN both_ways ON both_ways.a = walk.at AND both_ways.n < walk.edge)
""" + f" SELECT e1, e2, {r('weight')}, {r('sqrt(2 * (1 - weight))', 'distance')} FROM ranked_edges x WHERE NOT EXISTS (SELECT 1 FROM walk WHERE walk.edge = x.n AND walk.at = x.e2)",
    "set1_intersection": WITH + H + HALVES + " SELECT e1, e2 FROM es WHERE status = 'Both'",
    "set2_union": WITH + H + HALVES + " SELECT e1, e2 FROM es",
    "set3_difference": WITH + H + HALVES + " SELECT e1, e2 FROM es WHERE status = 'First only'",
    "set4_overlap": WITH + H + HALVES + f" SELECT count(weight_a) AS edges_a, count(weight_b) AS edges_b, count_if(status = 'Both') AS common, count_if(status = 'First only') AS a_only, count_if(status = 'Last only') AS b_only, count(*) AS union_edges, {r('''count_if(status = 'Both') / nullif(count(*), 0)''', 'jaccard')}, {r('''count_if(status = 'Both') / nullif(count(weight_a), 0)''', 'a_retention')}, {r('''count_if(status = 'Both') / nullif(count(weight_b), 0)''', 'b_support')} FROM es",
    "set5_edge_status": WITH + H + HALVES + f" SELECT e1, e2, {rs('weight_a', 'weight_b')}, status FROM es",
    "c1_pair_comparison": WITH + HP + TWO + f" SELECT e1, e2, {rs(*_PC)}, sign_flip, meaningful_sign_flip, relation_type FROM pc",
    "c2_comparison_summary": WITH + HP + TWO + " SELECT count(*) AS n_pairs, " + ", ".join(r(f"avg({c})", f"mean_{c}") for c in ("pearson", "partial", "abs_pearson", "abs_partial")) + f", {r('median(abs_pearson)', 'median_abs_pearson')}, {r('median(abs_partial)', 'median_abs_partial')}, count_if(abs_pearson >= 0.5) AS n_pearson_strong, count_if(abs_partial >= 0.2) AS n_partial_strong, count_if(attenuation > 0) AS n_weakened, count_if(sign_flip) AS n_sign_flip, count_if(meaningful_sign_flip) AS n_meaningful_sign_flip, {r('corr(pearson, partial)', 'pearson_partial_corr')} FROM pc",
    "c4_node_comparison": WITH + H + HALVES + """,
ia AS (SELECT e1 AS entity, weight FROM fa UNION ALL SELECT e2, weight FROM fa), ib AS (SELECT e1 AS entity, weight FROM la UNION ALL SELECT e2, weight FROM la),
da AS (SELECT d.entity, count(weight) AS degree, coalesce(sum(abs(weight)), 0) AS strength FROM dim d LEFT JOIN ia USING (entity) GROUP BY 1), db AS (SELECT d.entity, count(weight) AS degree, coalesce(sum(abs(weight)), 0) AS strength FROM dim d LEFT JOIN ib USING (entity) GROUP BY 1)""" + f" SELECT entity, da.degree AS first_degree, {r('da.strength', 'first_strength')}, db.degree AS last_degree, {r('db.strength', 'last_strength')}, db.degree - da.degree AS degree_change, {r('db.strength - da.strength', 'strength_change')} FROM da JOIN db USING (entity)",
    "e22_rolling_history": WITH + H + f" SELECT window_id, window_start, network_date, e1, e2, {r('weight')}, selected, same_grp FROM h",
    "n1_window_summary": WITH + H + states() + f" SELECT {_ST_INT}, {rs(*_ST_NUM)} FROM st",
    "n2_window_nodes": WITH + H + nodes() + f" SELECT window_id, network_date, entity, degree, same_degree, cross_degree, {rs('strength', 'same_strength', 'cross_strength')} FROM wn",
    "n3_turnover": WITH + H + moves() + f" SELECT {_TV_INT}, {rs('jaccard', 'turnover', 'retention', 'inherited_share', 'lost_rate', 'gained_rate', 'cross_change_share')}, rank() OVER (ORDER BY round(turnover, 12) DESC) AS turnover_rank FROM tv",
    "n4_edge_changes": WITH + H + moves() + " SELECT window_from, window_id AS window_to, date_from, network_date AS date_to, e1, e2, same_grp, CASE WHEN selected THEN 'gained' ELSE 'lost' END AS change_type FROM lagged WHERE was <> selected",
    "n6_persistence": WITH + H + persistent() + f" SELECT {_PS} FROM ps",
    "n7_persistence_by_relation": WITH + H + persistent() + f" SELECT relation, n_pairs, n_persistent, n_always, {rs('mean_persistence', 'median_persistence', 'mean_strength', 'persistent_share', 'always_share')} FROM pb",
    "n9_static_vs_dynamic": WITH + HP + persistent() + f" SELECT {_PS}, coalesce(abs(q.weight) >= 0.2, false) AS static_stable, persistence >= 0.5 AS dynamic_persistent, persistence >= 0.99998 AS always_selected, CASE WHEN coalesce(abs(q.weight) >= 0.2, false) AND persistence >= 0.5 THEN 'Static stable + Dynamic persistent' WHEN coalesce(abs(q.weight) >= 0.2, false) THEN 'Static stable only' WHEN persistence >= 0.5 THEN 'Dynamic persistent only' ELSE 'Neither' END AS stability_class FROM ps LEFT JOIN (SELECT e1, e2, weight FROM prs) q USING (e1, e2)",
    "n9_static_dynamic_summary": WITH + HP + persistent() + f", z AS (SELECT coalesce(abs(q.weight) >= 0.2, false) AS a, persistence >= 0.5 AS b, persistence >= 0.99998 AS c FROM ps LEFT JOIN (SELECT e1, e2, weight FROM prs) q USING (e1, e2)) SELECT count_if(a) AS n_static, count_if(b) AS n_dynamic, count_if(a AND b) AS common, count_if(a OR b) AS n_union, count_if(c) AS n_always, {r('count_if(a AND b) / nullif(count_if(a OR b), 0)', 'jaccard')}, {r('count_if(a AND b) / nullif(count_if(a), 0)', 'static_retained')}, {r('count_if(a AND b) / nullif(count_if(b), 0)', 'dynamic_supported')} FROM z",
    "n10_scale_summary": WITH + SCALES + states(SIZE) + moves(SIZE) + persistent(SIZE) + f" SELECT window_size, n_windows, {rs('mean_edges', 'sd_edges')}, min_edges, max_edges, {rs('mean_abs_weight', 'mean_same_ratio', 'mean_turnover', 'median_turnover', 'max_turnover')}, same_changes, cross_changes, n_persistent, n_always, {rs('same_mean_persistence', 'cross_mean_persistence')}, {r('cross_changes / nullif(same_changes + cross_changes, 0)', 'cross_change_share')} FROM (SELECT window_size, count(*) AS n_windows, avg(edge_count) AS mean_edges, stddev_samp(edge_count) AS sd_edges, min(edge_count) AS min_edges, max(edge_count) AS max_edges, avg(mean_abs_weight) AS mean_abs_weight, avg(same_ratio) AS mean_same_ratio FROM st GROUP BY 1) JOIN (SELECT window_size, avg(turnover) AS mean_turnover, median(turnover) AS median_turnover, max(turnover) AS max_turnover, CAST(sum(same_edge_changes) AS BIGINT) AS same_changes, CAST(sum(cross_edge_changes) AS BIGINT) AS cross_changes FROM tv GROUP BY 1) USING (window_size) JOIN (SELECT window_size, count_if(persistence >= 0.8) AS n_persistent, count_if(persistence >= 0.99998) AS n_always, avg(persistence) FILTER (same_grp) AS same_mean_persistence, avg(persistence) FILTER (NOT same_grp) AS cross_mean_persistence FROM ps GROUP BY 1) USING (window_size)",
    "n11_multi_scale": WITH + SCALES + persistent(SIZE) + MULTI + f" SELECT e1, e2, same_grp, {rs('persistence_18', 'persistence_24', 'persistence_36', 'min_persistence', 'mean_persistence', 'max_persistence', 'sd_persistence', 'range_persistence')}, n_scales, persistent_all, always_all, scale_dependent, pattern, core_class FROM ms",
    "n13_multi_scale_summary": WITH + SCALES + persistent(SIZE) + MULTI + f" SELECT {MULTI_SUMS} FROM ms",
    "n34_ranked_nodes": WITH + H + ranked(5) + f" SELECT window_id, network_date, entity, degree, same_degree, cross_degree, {rs('strength', 'same_strength', 'cross_strength', 'degree_rank', 'strength_rank')}, top_degree, top_strength FROM rk",
    "n14_centrality_stability": WITH + H + STABLE + f" SELECT entity, n_windows, {rs(*_STABLE_COLS)} FROM cs",
    "n15_node_roles": WITH + H + STABLE + """,
lim AS (SELECT median(round(sd_degree_rank, 9)) AS d, median(round(sd_strength_rank, 9)) AS s FROM cs),
ro AS (SELECT entity, CASE WHEN round(mean_degree_rank, 9) <= 8 THEN CASE WHEN round(sd_degree_rank, 9) <= d THEN 'Stable central' ELSE 'Dynamic central' END ELSE CASE WHEN round(sd_degree_rank, 9) <= d THEN 'Stable peripheral' ELSE 'Dynamic peripheral' END END AS degree_role,
       CASE WHEN round(mean_strength_rank, 9) <= 8 THEN CASE WHEN round(sd_strength_rank, 9) <= s THEN 'Stable central' ELSE 'Dynamic central' END ELSE CASE WHEN round(sd_strength_rank, 9) <= s THEN 'Stable peripheral' ELSE 'Dynamic peripheral' END END AS strength_role FROM cs, lim)
SELECT *, CASE WHEN degree_role = 'Stable central' AND strength_role = 'Stable central' THEN 'Strong stable central' WHEN 'Dynamic central' IN (degree_role, strength_role) THEN 'Dynamic central candidate' WHEN degree_role = strength_role AND degree_role LIKE '%peripheral' THEN degree_role ELSE 'Mixed role' END AS combined_role FROM ro""",
    "n16_episodes": WITH + H + EPISODES + " SELECT * FROM ep",
    "n17_lifecycle": WITH + H + LIFE + f" SELECT e1, e2, same_grp, total_windows, windows_selected, switch_count, entry_count, exit_count, first_selected, last_selected, selection_sequence, n_episodes, longest_run, longest_run_start, longest_run_end, lifecycle_class, {rs('mean_when_selected', 'mean_abs_when_selected', 'max_abs_when_selected', 'mean_episode_length', 'persistence', 'longest_run_share', 'transition_rate', 'sign_consistency')} FROM lf",
    "n19_lifecycle_classes": WITH + H + LIFE + f" SELECT CASE WHEN same_grp THEN 'Same' ELSE 'Cross' END AS relation, lifecycle_class, count(*) AS n_edges, {r('avg(persistence)', 'mean_persistence')}, {r('avg(transition_rate)', 'mean_transition_rate')}, {r('avg(n_episodes)', 'mean_episodes')}, {r('count(*) / sum(count(*)) OVER (PARTITION BY CASE WHEN same_grp THEN 1 ELSE 0 END)', 'share')} FROM lf GROUP BY same_grp, lifecycle_class",
    "n20_transition_rates": WITH + SCALES + moves(SIZE) + RATES + f" SELECT window_size, relation, n_pairs, n_windows, opportunities, state_changes, entries, exits, selected_exposures, absent_exposures, {rs('state_change_rate', 'entry_rate', 'exit_rate', 'average_edges', 'share_of_changes')} FROM rates",
    "n21_relation_contrast": WITH + SCALES + moves(SIZE) + RATES + persistent(SIZE) + CONTRAST + " SELECT window_size, " + rs(*[f"{k}_{m}" for m in ("mean_persistence", "persistent_share", "always_share", "state_change_rate", "entry_rate", "exit_rate") for k in ("same", "cross")], "cross_share_of_changes", "persistence_difference", "persistence_ratio", "persistent_ratio", "always_ratio", "change_ratio", "exit_ratio") + " FROM ct",
    "n23_evidence_matrix": WITH + SCALES + moves(SIZE) + RATES + persistent(SIZE) + MULTI + CONTRAST + ", sc AS (SELECT CASE WHEN same_grp THEN 'Same' ELSE 'Cross' END AS relation, count_if(persistent_all) / count(*) AS m, count_if(always_all) / count(*) AS a FROM ms GROUP BY 1), one AS (SELECT max(m) FILTER (relation = 'Same') AS sm, max(m) FILTER (relation = 'Cross') AS cm, max(a) FILTER (relation = 'Same') AS sa, max(a) FILTER (relation = 'Cross') AS ca FROM sc), ev AS (" + " UNION ALL ".join(f"SELECT '{g}' AS evidence_group, CAST(window_size AS VARCHAR) AS window_size, '{t}' AS criterion, coalesce({'same' if more else 'cross'}_{m} > {'cross' if more else 'same'}_{m}, false) AS support, same_{m} AS same_value, cross_{m} AS cross_value FROM ct" for g, t, m, more in (("Multi-scale persistence", "Same mean persistence > Cross mean persistence", "mean_persistence", True), ("Persistent-edge rate", "Same persistent rate > Cross persistent rate", "persistent_share", True), ("State-change dynamics", "Cross normalized change rate > Same normalized change rate", "state_change_rate", False), ("Exit dynamics", "Cross exit rate > Same exit rate", "exit_rate", False))) + " UNION ALL SELECT 'True multi-scale core', 'All', 'Same multi-scale core rate > Cross multi-scale core rate', coalesce(sm > cm, false), sm, cm FROM one UNION ALL SELECT 'Always multi-scale core', 'All', 'Same always-core rate > Cross always-core rate', coalesce(sa > ca, false), sa, ca FROM one)" + f" SELECT evidence_group, window_size, criterion, support, {rs('same_value', 'cross_value')} FROM ev",
    "n24_state_table": WITH + H + STATE + f" SELECT {_ST_INT}, {rs(*_ST_NUM)}, " + ", ".join(c if c not in ("jaccard", "turnover", "cross_change_share") else r(c) for c in _MOVES) + ", " + rs(*[f"{c}_z" for c in _ZS]) + ", high_turnover_z1, high_turnover_z1_5, high_change_z1 FROM s",
    "n25_change_scores": WITH + H + SCORE + f" SELECT window_id, network_date, gross_edge_changes, net_edge_change, cross_edge_changes, abs_edge_count_change, delta_same_edges, delta_cross_edges, high_change_joint, robust_high_turnover, robust_high_gross_change, change_type, change_source, high_change_moderate, high_change_strong, high_change_very_strong, {rs('turnover', 'cross_change_share', 'rewiring_share', 'delta_mean_abs_weight', 'delta_same_ratio', 'turnover_z', 'gross_edge_changes_z', 'abs_edge_count_change_z', 'cross_edge_changes_z', 'turnover_robust_z', 'gross_edge_changes_robust_z', 'core_change_score', 'max_core_z')} FROM c",
    "n27_threshold_summary": WITH + H + SCORE + ", lg AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM c" for m in ("turnover", "gross_edge_changes", "abs_edge_count_change")) + f"), mm AS (SELECT metric, avg(value) AS mean, stddev_samp(value) AS sd, median(value) AS med FROM lg GROUP BY 1), dd AS (SELECT metric, median(abs(value - med)) AS mad FROM lg JOIN mm USING (metric) GROUP BY 1) SELECT metric, {rs('mean', 'sd')}, {r('med', 'median')}, {r('mad')}, {r('mean + sd', 'z1_raw')}, {r('mean + 1.5 * sd', 'z1_5_raw')}, {r('mean + 2 * sd', 'z2_raw')} FROM mm JOIN dd USING (metric)",
    "n28_regimes": WITH + H + REGIME + f" SELECT window_id, network_date, regime, n_regimes, {rs('rss', 'bic_style')} FROM rg",
    "n29_regime_summary": WITH + H + RSUM + " SELECT regime, start_date, end_date, n_networks, " + rs(*[n for _, n in _RSUM]) + " FROM rsum",
    "n30_change_points": WITH + H + RSUM + """,
zz AS (SELECT regime, avg(f0) AS z0, avg(f1) AS z1, avg(f2) AS z2 FROM (SELECT regime, row_number() OVER (ORDER BY network_date) AS i FROM rg) JOIN fz USING (i) GROUP BY 1),
cp AS (SELECT a.regime AS previous_regime, b.regime AS new_regime, a.end_date AS previous_end, b.start_date AS new_start, b.mean_same_edges - a.mean_same_edges AS delta_same_edges, b.mean_cross_edges - a.mean_cross_edges AS delta_cross_edges,
       b.mean_edge_count - a.mean_edge_count AS delta_edge_count, b.mean_abs_weight - a.mean_abs_weight AS delta_mean_abs_weight, b.mean_same_ratio - a.mean_same_ratio AS delta_same_ratio,
       sqrt((y.z0 - x.z0) ** 2 + (y.z1 - x.z1) ** 2 + (y.z2 - x.z2) ** 2) AS jump_norm FROM rsum a JOIN rsum b ON b.regime = a.regime + 1 JOIN zz x ON x.regime = a.regime JOIN zz y ON y.regime = b.regime)""" + f" SELECT previous_regime, new_regime, previous_end, new_start, {rs('delta_same_edges', 'delta_cross_edges', 'delta_edge_count', 'delta_mean_abs_weight', 'delta_same_ratio', 'jump_norm')}, {r('turnover', 'boundary_turnover')}, gross_edge_changes AS boundary_gross_edge_changes, net_edge_change AS boundary_net_edge_change, lost_edges AS boundary_lost_edges, gained_edges AS boundary_gained_edges, {r('cross_change_share', 'boundary_cross_change_share')} FROM cp LEFT JOIN s ON s.network_date = cp.new_start",
    "n31_regime_persistence": WITH + H + RPERS + f" SELECT regime, e1, e2, same_grp, n_windows, windows_selected, {rs('mean_when_selected', 'mean_abs_when_selected', 'max_abs_when_selected', 'persistence')}, is_core, is_always FROM rp",
    "n32_regime_structure": WITH + H + RPERS + f", rx AS (SELECT regime, avg(persistence) AS mean_edge_persistence, count_if(is_core) AS n_core, count_if(is_core AND same_grp) AS n_same_core, count_if(is_core AND NOT same_grp) AS n_cross_core, count_if(is_always) AS n_always, count_if(is_always AND same_grp) AS n_same_always, count_if(is_always AND NOT same_grp) AS n_cross_always FROM rp GROUP BY 1) SELECT regime, start_date, end_date, n_networks, {rs('mean_edge_count', 'mean_same_ratio', 'mean_abs_weight', 'mean_edge_persistence')}, n_core, n_same_core, n_cross_core, n_always, n_same_always, n_cross_always, {r('n_same_core / nullif(n_core, 0)', 'same_share_of_core')} FROM rsum JOIN rx USING (regime)",
    "n33_regime_edge_change": WITH + H + RCHANGE + f" SELECT e1, e2, same_grp, regime_before, regime_after, {rs('persistence_before', 'persistence_after', 'delta_persistence', 'abs_delta')}, core_before, core_after, always_before, always_after, core_transition FROM rc",
    "n33_regime_change_summary": WITH + H + RCHANGE + f" SELECT regime_before, regime_after, count_if(core_before) AS n_core_before, count_if(core_after) AS n_core_after, count_if(core_before AND core_after) AS common_core, count_if(core_before AND NOT core_after) AS lost_core, count_if(NOT core_before AND core_after) AS gained_core, count_if(core_before AND NOT core_after AND same_grp) AS lost_same_core, count_if(core_before AND NOT core_after AND NOT same_grp) AS lost_cross_core, count_if(NOT core_before AND core_after AND same_grp) AS gained_same_core, count_if(NOT core_before AND core_after AND NOT same_grp) AS gained_cross_core, {r('avg(delta_persistence)', 'mean_delta')}, {r('avg(abs_delta)', 'mean_abs_delta')}, count_if(delta_persistence <= -0.5) AS n_large_drop, count_if(delta_persistence >= 0.5) AS n_large_gain, {r('CASE WHEN count_if(core_before OR core_after) = 0 THEN 1.0 ELSE count_if(core_before AND core_after) / count_if(core_before OR core_after) END', 'core_jaccard')} FROM rc GROUP BY 1, 2",
    "n35_regime_nodes": WITH + H + rnodes(REGIME) + " SELECT regime, entity, n_networks, " + rs(*[f"mean_{c}" for c in _NODE], "sd_degree", "sd_strength", "top_degree_share", "top_strength_share") + " FROM rn",
    "n36_node_change": WITH + H + rnodes(REGIME) + NCHANGE + " SELECT regime_before, regime_after, entity, " + rs(*_NC) + " FROM nc",
    "n37_edge_burden": WITH + H + BURDEN + f" SELECT regime_before, regime_after, entity, {', '.join(_BU_INT)}, {rs(*_BU_NUM)} FROM bu",
    "n38_contributors": WITH + H + rnodes(BURDEN) + NCHANGE + f" SELECT regime_before, regime_after, entity, {rs(*_NC)}, {', '.join(_BU_INT)}, {rs(*_BU_NUM)}, CASE WHEN lost_core_incident = 0 AND gained_core_incident = 0 THEN 'Limited core change' WHEN gained_core_incident = 0 THEN 'Loss-dominated' WHEN lost_core_incident = 0 THEN 'Gain-dominated' ELSE 'Rewiring' END AS node_transition_mode FROM nc JOIN bu USING (regime_before, regime_after, entity)",
    "n39_window_pairs": WITH + H + _PAIRS_OF_WINDOWS + " SELECT * FROM wc",
    "n39_window_pair_summary": WITH + H + _PAIRS_OF_WINDOWS + f" SELECT window_a, window_b, count_if(change = 'common') AS common, count_if(change = 'lost') AS lost, count_if(change = 'gained') AS gained, {r('''count_if(change = 'common') / count(*)''', 'jaccard')} FROM wc GROUP BY 1, 2",
}
