"""What changes between the networks of successive windows.

An edge history has one row for every pair in every window:
(window_id, window_start, network_date, e1, e2, weight, selected, same_grp),
and may have further key columns (``keys``, such as window_size).  Adjacent
windows are compared by ``lag`` over a pair's rows, so one shuffle by pair
serves turnover, change logs, episodes and transition rates alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import EPS, isclose, median, ratio, row_mean, row_sd, safe_corr, variation
from ..shipping import apply_groups
from .graph import components, incidence

PERSISTENT, LARGE_SHIFT = 0.8, 0.5
Keys = tuple[str, ...]


def rolling_pearson(returns: DataFrame, dim: DataFrame, size: int = 24, step: int = 3, least: float = 0.3, min_periods: int = 3) -> DataFrame:
    """An edge history from pairwise-complete correlations over count-based windows; selected at abs >= least.

    Pair products are made once per date and summed by a frame of dates, so the panel isn't copied into its windows; a
    pair has a row for every window at whose last date both entities are listed.  Each entity's mean is taken off first,
    which correlations don't see and sums of squares do.
    """
    dates = returns.select("k", "t").distinct().withColumn("i", F.row_number().over(W.orderBy("k")) - 1)
    rows = returns.select("k", "entity", (F.col("ret") - F.avg("ret").over(W.partitionBy("entity"))).alias("ret"))
    a, b = rows.select("k", F.col("entity").alias("e1"), F.col("ret").alias("x")), rows.select("k", F.col("entity").alias("e2"), F.col("ret").alias("y"))
    both = a.join(b, "k").filter("e1 < e2").join(F.broadcast(dates), "k")  # one row per date
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    frame = W.partitionBy("e1", "e2").orderBy("i").rangeBetween(-(size - 1), 0)
    total = lambda c: F.sum(F.when(ok, c)).over(frame)
    sums = both.select("e1", "e2", "i", F.col("t").alias("network_date"), F.first("t").over(frame).alias("window_start"), F.count_if(ok).over(frame).alias("n"), total(F.col("x")).alias("sx"), total(F.col("y")).alias("sy"), total(F.col("x") * F.col("x")).alias("sxx"), total(F.col("y") * F.col("y")).alias("syy"), total(F.col("x") * F.col("y")).alias("sxy"))
    sums = sums.filter((F.col("i") >= size - 1) & ((F.col("i") - (size - 1)) % step == 0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    corr = F.when((F.col("n") >= min_periods) & (vx > EPS) & (vy > EPS), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    out = sums.select(((F.col("i") - (size - 1)) / step + 1).cast("int").alias("window_id"), "window_start", "network_date", "e1", "e2", corr.alias("weight"))
    out = out.withColumn("selected", F.coalesce(F.abs("weight") >= least, F.lit(False)))
    return with_relation(out, dim)


def with_relation(history: DataFrame, dim: DataFrame) -> DataFrame:
    """history with same_grp, joined late from the entity dimension."""
    side = lambda k: F.broadcast(dim.select(F.col("entity").alias(f"e{k}"), F.col("grp").alias(f"_g{k}")))  # noqa: E731  one row per node
    return history.join(side(1), "e1", "left").join(side(2), "e2", "left").withColumn("same_grp", F.coalesce(F.col("_g1") == F.col("_g2"), F.lit(False))).drop("_g1", "_g2")


def relation() -> Column:
    return F.when(F.col("same_grp"), "Same").otherwise("Cross")


def _on(value: Column | str) -> Column:
    return F.when(F.col("selected"), F.col(value) if isinstance(value, str) else value)


def _count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


# --- windows: N1, N2, N5, N34 ----------------------------------------------------------------------------------


def window_summary(history: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per window: edges, density, degrees, isolates, strengths over selected edges, same/cross edges and ratios, signs."""
    on, same = F.col("selected"), F.col("same_grp")
    strength = F.abs(F.col("weight"))
    out = history.groupBy(*keys, "window_id", "window_start", "network_date").agg(
        _count(on).alias("edge_count"), ratio(_count(on), F.count(F.lit(1))).alias("density"), F.avg(_on(strength)).alias("mean_abs_weight"), median(_on(strength)).alias("median_abs_weight"),
        F.coalesce(F.sum(_on(strength)), F.lit(0.0)).alias("total_abs_weight"), _count(on & same).alias("same_edges"), _count(on & ~same).alias("cross_edges"),
        F.avg(F.when(on & same, strength)).alias("mean_abs_same"), F.avg(F.when(on & ~same, strength)).alias("mean_abs_cross"),
        median(F.when(on & same, strength)).alias("median_abs_same"), median(F.when(on & ~same, strength)).alias("median_abs_cross"),
        _count(on & (F.col("weight") > 0)).alias("positive_edges"), _count(on & (F.col("weight") < 0)).alias("negative_edges"),
    )
    out = out.withColumns({"same_ratio": ratio("same_edges", "edge_count"), "cross_ratio": ratio("cross_edges", "edge_count")})
    nodes = window_nodes(history, keys).groupBy(*keys, "window_id").agg(F.avg(F.col("degree").cast("double")).alias("mean_degree"), F.max("degree").alias("max_degree"), _count(F.col("degree") == 0).alias("n_isolated"))
    return out.join(nodes, [*keys, "window_id"])


def window_nodes(history: DataFrame, keys: Keys = ()) -> DataFrame:
    """Per window and node: degree, strength and their same/cross parts."""
    rows = incidence(history, *keys, "window_id", "network_date", "weight", "selected", "same_grp")
    on, same, strength = F.col("selected"), F.col("same_grp"), F.abs(F.col("weight"))
    total = lambda c: F.coalesce(F.sum(F.when(c, strength)), F.lit(0.0))
    return rows.groupBy(*keys, "window_id", "network_date", "entity").agg(
        _count(on).alias("degree"), total(on).alias("strength"), _count(on & same).alias("same_degree"), _count(on & ~same).alias("cross_degree"), total(on & same).alias("same_strength"), total(on & ~same).alias("cross_strength")
    )


def window_components(history: DataFrame) -> DataFrame:
    """(window_id, n_components, largest): connected components of each window's selected edges, isolated nodes counted."""
    name = lambda c: F.concat_ws("|", F.col("window_id"), F.col(c))
    nodes = history.select("window_id", F.explode(F.array("e1", "e2")).alias("node")).distinct().select(name("node").alias("entity"))
    found = components(nodes, history.filter("selected").select(name("e1").alias("e1"), name("e2").alias("e2")))
    found = found.withColumn("window_id", F.substring_index("entity", "|", 1).cast("int"))
    return found.groupBy("window_id").agg(F.countDistinct("component").alias("n_components"), F.max("component_size").alias("largest"))


def average_rank(by: list[str], value: str) -> Column:
    """Descending rank with ties at their mean."""
    order, ties = W.partitionBy(*by).orderBy(F.col(value).desc()), W.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2


def ranked_nodes(history: DataFrame, top: int, keys: Keys = (), digits: int = 9) -> DataFrame:
    """window_nodes with average ranks of degree and strength and whether they are at most ``top``."""
    nodes = window_nodes(history, keys).withColumn("strength", F.round("strength", digits))
    by = [*keys, "window_id"]
    nodes = nodes.withColumns({"degree_rank": average_rank(by, "degree"), "strength_rank": average_rank(by, "strength")})
    return nodes.withColumns({"top_degree": F.col("degree_rank") <= top, "top_strength": F.col("strength_rank") <= top})


# --- transitions: N3, N4, N8, N20 ------------------------------------------------------------------------------


def transitions(history: DataFrame, keys: Keys = ()) -> DataFrame:
    """history with the pair's state in the window before (null in its first window)."""
    w = W.partitionBy(*keys, "e1", "e2").orderBy("window_id")
    return history.withColumns({"before": F.lag("selected").over(w), "window_from": F.lag("window_id").over(w), "date_from": F.lag("network_date").over(w)})


def turnover(history: DataFrame, keys: Keys = ()) -> DataFrame:
    """One row per transition: sizes, common/lost/gained/union, Jaccard (1 for two empty networks), rates, same/cross parts, rank."""
    now, was, same = F.col("selected"), F.col("before"), F.col("same_grp")
    moves = transitions(history, keys).filter("before IS NOT NULL")
    out = moves.groupBy(*keys, "window_from", F.col("window_id").alias("window_to"), "date_from", F.col("network_date").alias("date_to")).agg(
        _count(was).alias("edges_from"), _count(now).alias("edges_to"), _count(was & now).alias("common_edges"), _count(was & ~now).alias("lost_edges"), _count(~was & now).alias("gained_edges"), _count(was | now).alias("union_edges"),
        _count(was & ~now & same).alias("lost_same"), _count(was & ~now & ~same).alias("lost_cross"), _count(~was & now & same).alias("gained_same"), _count(~was & now & ~same).alias("gained_cross"),
    )
    jaccard = F.when(F.col("union_edges") == 0, 1.0).otherwise(ratio("common_edges", "union_edges"))
    out = out.withColumns({
        "net_edge_change": F.col("edges_to") - F.col("edges_from"), "gross_edge_changes": F.col("lost_edges") + F.col("gained_edges"), "jaccard": jaccard, "turnover": 1 - jaccard,
        "retention": ratio("common_edges", "edges_from"), "inherited_share": ratio("common_edges", "edges_to"), "lost_rate": ratio("lost_edges", "edges_from"), "gained_rate": ratio("gained_edges", "edges_to"),
        "same_edge_changes": F.col("lost_same") + F.col("gained_same"), "cross_edge_changes": F.col("lost_cross") + F.col("gained_cross"), "net_same": F.col("gained_same") - F.col("lost_same"), "net_cross": F.col("gained_cross") - F.col("lost_cross"),
    })
    out = out.withColumn("cross_change_share", ratio("cross_edge_changes", "gross_edge_changes"))
    return out.withColumn("turnover_rank", F.rank().over(W.partitionBy(*keys).orderBy(F.round("turnover", 12).desc())))


def edge_changes(history: DataFrame, keys: Keys = ()) -> DataFrame:
    moves = transitions(history, keys).filter("before IS NOT NULL AND before <> selected")
    return moves.select(*keys, "window_from", F.col("window_id").alias("window_to"), "date_from", F.col("network_date").alias("date_to"), "e1", "e2", "same_grp", F.when(F.col("selected"), "gained").otherwise("lost").alias("change_type"))


def transition_rates(history: DataFrame, keys: Keys = ()) -> DataFrame:
    """By relation: opportunities, changes, entries, exits, and their rates per exposure."""
    now, was = F.col("selected"), F.col("before")
    moves = transitions(history, keys).withColumn("relation", relation())
    out = moves.groupBy(*keys, "relation").agg(
        F.countDistinct("e1", "e2").alias("n_pairs"), F.countDistinct("network_date").alias("n_windows"), _count(was != now).alias("state_changes"), _count(~was & now).alias("entries"), _count(was & ~now).alias("exits"),
        _count(was).alias("selected_exposures"), _count(~was).alias("absent_exposures"), _count(now).alias("_on"),
    )
    out = out.withColumn("opportunities", F.col("n_pairs") * (F.col("n_windows") - 1))
    w = W.partitionBy(*keys)
    return out.select(*keys, "relation", "n_pairs", "n_windows", "opportunities", "state_changes", "entries", "exits", "selected_exposures", "absent_exposures", ratio("state_changes", "opportunities").alias("state_change_rate"), ratio("entries", "absent_exposures").alias("entry_rate"), ratio("exits", "selected_exposures").alias("exit_rate"), ratio("_on", "n_windows").alias("average_edges"), ratio(F.col("state_changes"), F.sum("state_changes").over(w)).alias("share_of_changes"))


# --- persistence: N6, N7, N9 -------------------------------------------------------------------------------------


def persistence(history: DataFrame, keys: Keys = ()) -> DataFrame:
    on = F.col("selected")
    out = history.groupBy(*keys, "e1", "e2", "same_grp").agg(
        _count(on).alias("windows_selected"), F.count(F.lit(1)).alias("total_windows"), F.avg("weight").alias("mean_weight"), F.avg(F.abs("weight")).alias("mean_abs_weight"),
        F.avg(_on("weight")).alias("mean_when_selected"), F.avg(_on(F.abs("weight"))).alias("mean_abs_when_selected"), F.min(_on("network_date")).alias("first_selected"), F.max(_on("network_date")).alias("last_selected"),
    )
    return out.withColumn("persistence", ratio("windows_selected", "total_windows"))


def persistence_by_relation(table: DataFrame, keys: Keys = ()) -> DataFrame:
    p = F.col("persistence")
    out = table.withColumn("relation", relation()).groupBy(*keys, "relation").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(p).alias("mean_persistence"), median(p).alias("median_persistence"), _count(p >= PERSISTENT).alias("n_persistent"), _count(isclose(p, F.lit(1.0))).alias("n_always"), F.avg("mean_abs_when_selected").alias("mean_strength")
    )
    return out.withColumns({"persistent_share": ratio("n_persistent", "n_pairs"), "always_share": ratio("n_always", "n_pairs")})


def static_vs_dynamic(table: DataFrame, static: DataFrame, least: float = PERSISTENT) -> DataFrame:
    """persistence joined with (e1, e2, static_stable): flags and the four-way class."""
    out = table.join(static.select("e1", "e2", "static_stable"), ["e1", "e2"], "left")
    fixed, moving = F.coalesce("static_stable", F.lit(False)), F.col("persistence") >= least
    kind = F.when(fixed & moving, "Static stable + Dynamic persistent").when(fixed, "Static stable only").when(moving, "Dynamic persistent only").otherwise("Neither")
    return out.withColumns({"static_stable": fixed, "dynamic_persistent": moving, "always_selected": isclose("persistence", F.lit(1.0)), "stability_class": kind})


def static_dynamic_summary(classed: DataFrame) -> DataFrame:
    a, b = F.col("static_stable"), F.col("dynamic_persistent")
    out = classed.agg(_count(a).alias("n_static"), _count(b).alias("n_dynamic"), _count(a & b).alias("common"), _count(a | b).alias("n_union"), _count(F.col("always_selected")).alias("n_always"))
    return out.withColumns({"jaccard": ratio("common", "n_union"), "static_retained": ratio("common", "n_static"), "dynamic_supported": ratio("common", "n_dynamic")})


# --- scales: N10 - N13, N21 - N23 --------------------------------------------------------------------------------


def scale_summary(history: DataFrame) -> DataFrame:
    """One row per window_size: edges, turnover, persistence by relation, share of cross changes."""
    k = ("window_size",)
    states = window_summary(history, k).groupBy(*k).agg(F.count(F.lit(1)).alias("n_windows"), F.avg(F.col("edge_count").cast("double")).alias("mean_edges"), F.stddev_samp("edge_count").alias("sd_edges"), F.min("edge_count").alias("min_edges"), F.max("edge_count").alias("max_edges"), F.avg("mean_abs_weight").alias("mean_abs_weight"), F.avg("same_ratio").alias("mean_same_ratio"))
    moves = turnover(history, k).groupBy(*k).agg(F.avg("turnover").alias("mean_turnover"), median("turnover").alias("median_turnover"), F.max("turnover").alias("max_turnover"), F.sum("same_edge_changes").alias("same_changes"), F.sum("cross_edge_changes").alias("cross_changes"))
    p = F.col("persistence")
    pairs = persistence(history, k).groupBy(*k).agg(_count(p >= PERSISTENT).alias("n_persistent"), _count(isclose(p, F.lit(1.0))).alias("n_always"), F.avg(F.when(F.col("same_grp"), p)).alias("same_mean_persistence"), F.avg(F.when(~F.col("same_grp"), p)).alias("cross_mean_persistence"))
    return states.join(moves, list(k), "left").join(pairs, list(k)).withColumn("cross_change_share", ratio(F.col("cross_changes"), F.col("same_changes") + F.col("cross_changes")))


def multi_scale(table: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Persistence by scale side by side; least, mean, largest, sd, range; at how many scales it is persistent; pattern and core class."""
    names = [f"persistence_{s}" for s in sizes]
    wide = table.groupBy("e1", "e2", "same_grp").pivot("window_size", list(sizes)).agg(F.first("persistence"))
    wide = wide.select("e1", "e2", "same_grp", *[F.col(str(s)).alias(n) for s, n in zip(sizes, names, strict=True)])
    low, high = F.least(*names), F.greatest(*names)
    scales = sum(((F.col(n) >= PERSISTENT).cast("int") for n in names[1:]), (F.col(names[0]) >= PERSISTENT).cast("int"))
    always = isclose(low, F.lit(1.0), atol=1e-10)
    steps = list(zip(names, names[1:], strict=False))
    every = lambda f: [f(F.col(a), F.col(b)) for a, b in steps]
    both = lambda cs: cs[0] if len(cs) == 1 else cs[0] & both(cs[1:])
    pattern = F.when(both(every(lambda a, b: F.abs(a - b) <= EPS)), "Constant").when(both(every(lambda a, b: a <= b + EPS)), "Non-decreasing with W").when(both(every(lambda a, b: a >= b - EPS)), "Non-increasing with W").otherwise("Non-monotonic")
    n = len(sizes)
    core = F.when(always, "Always persistent at all scales").when(scales == n, "Multi-scale persistent")
    for k in range(n - 1, 0, -1):
        core = core.when(scales == k, f"Persistent at {k} scale{'s' * (k > 1)}")
    return wide.withColumns({
        "min_persistence": low, "mean_persistence": row_mean(*names), "max_persistence": high, "sd_persistence": row_sd(*names), "range_persistence": high - low, "n_scales": scales, "persistent_all": scales == n, "always_all": always,
        "scale_dependent": (scales > 0) & (scales < n), "pattern": pattern, "core_class": core.otherwise("Not persistent at any scale"),
    })


def multi_scale_summary(table: DataFrame, by_relation: bool = False) -> DataFrame:
    rows = table.withColumn("relation", relation()) if by_relation else table
    out = rows.groupBy(*(["relation"] if by_relation else [])).agg(
        F.count(F.lit(1)).alias("n_pairs"), _count(F.col("persistent_all")).alias("n_multi_scale"), _count(F.col("always_all")).alias("n_always"), _count(F.col("scale_dependent")).alias("n_scale_dependent"),
        F.avg("min_persistence").alias("mean_min_persistence"), median("min_persistence").alias("median_min_persistence"), F.avg("range_persistence").alias("mean_range"), F.max("range_persistence").alias("max_range"),
    )
    return out.withColumns({"multi_scale_rate": ratio("n_multi_scale", "n_pairs"), "always_rate": ratio("n_always", "n_pairs")})


def relation_contrast(by_relation: DataFrame, rates: DataFrame, keys: Keys = ("window_size",)) -> DataFrame:
    """Same against cross side by side, with safe ratios."""
    on = [*keys, "relation"]
    rows = by_relation.join(rates.select(*on, "state_change_rate", "entry_rate", "exit_rate", "share_of_changes"), on)
    pick = lambda kind, c: F.max(F.when(F.col("relation") == kind, F.col(c)))
    measures = ("mean_persistence", "persistent_share", "always_share", "state_change_rate", "entry_rate", "exit_rate")
    out = rows.groupBy(*keys).agg(*[pick(kind, m).alias(f"{kind.lower()}_{m}") for m in measures for kind in ("Same", "Cross")], pick("Cross", "share_of_changes").alias("cross_share_of_changes"))
    over = lambda a, b: F.when(F.abs(F.col(b)) > EPS, F.col(a) / F.col(b))
    return out.withColumns({
        "persistence_difference": F.col("same_mean_persistence") - F.col("cross_mean_persistence"), "persistence_ratio": over("same_mean_persistence", "cross_mean_persistence"), "persistent_ratio": over("same_persistent_share", "cross_persistent_share"),
        "always_ratio": over("same_always_share", "cross_always_share"), "change_ratio": over("cross_state_change_rate", "same_state_change_rate"), "exit_ratio": over("cross_exit_rate", "same_exit_rate"),
    })


def evidence_matrix(contrast: DataFrame, scales: DataFrame) -> DataFrame:
    """(evidence_group, window_size, criterion, support, same_value, cross_value): four criteria per scale and two over all."""
    rules = [
        ("Multi-scale persistence", "Same mean persistence > Cross mean persistence", "mean_persistence", True),
        ("Persistent-edge rate", "Same persistent rate > Cross persistent rate", "persistent_share", True),
        ("State-change dynamics", "Cross normalized change rate > Same normalized change rate", "state_change_rate", False),
        ("Exit dynamics", "Cross exit rate > Same exit rate", "exit_rate", False),
    ]
    row = lambda group, size, text, same, cross, more: F.struct(F.lit(group).alias("evidence_group"), size.alias("window_size"), F.lit(text).alias("criterion"), F.coalesce(same > cross if more else cross > same, F.lit(False)).alias("support"), same.alias("same_value"), cross.alias("cross_value"))
    by_scale = contrast.select(F.inline(F.array(*[row(g, F.col("window_size").cast("string"), t, F.col(f"same_{m}"), F.col(f"cross_{m}"), more) for g, t, m, more in rules])))
    pick = lambda kind, c: F.max(F.when(F.col("relation") == kind, F.col(c))).alias(f"{kind}_{c}")
    one = scales.agg(*[pick(k, c) for k in ("Same", "Cross") for c in ("multi_scale_rate", "always_rate")])
    overall = [("True multi-scale core", "Same multi-scale core rate > Cross multi-scale core rate", "multi_scale_rate"), ("Always multi-scale core", "Same always-core rate > Cross always-core rate", "always_rate")]
    return by_scale.unionByName(one.select(F.inline(F.array(*[row(g, F.lit("All"), t, F.col(f"Same_{c}"), F.col(f"Cross_{c}"), True) for g, t, c in overall]))))


# --- centrality: N14, N15 ----------------------------------------------------------------------------------------


def centrality_stability(ranked: DataFrame) -> DataFrame:
    """Per node over the windows: moments and ranges of degree, strength and their ranks, top shares, corr(degree, strength)."""
    parts = []
    for c in ("degree", "strength", "degree_rank", "strength_rank"):
        v = F.col(c).cast("double")
        parts += [F.avg(v).alias(f"mean_{c}"), F.stddev_samp(v).alias(f"sd_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}"), (F.max(v) - F.min(v)).alias(f"range_{c}")]
    out = ranked.groupBy("entity").agg(F.count(F.lit(1)).alias("n_windows"), *parts, F.avg(F.col("top_degree").cast("double")).alias("top_degree_share"), F.avg(F.col("top_strength").cast("double")).alias("top_strength_share"), safe_corr(F.col("degree").cast("double"), F.col("strength")).alias("degree_strength_corr"))
    return out.withColumns({"cv_degree": variation("mean_degree", "sd_degree"), "cv_strength": variation("mean_strength", "sd_strength")})


def node_roles(stability: DataFrame, top: int) -> DataFrame:
    """Central (mean rank at most ``top``) by stable (rank sd at most the nodes' median), for degree, strength and both."""
    limits = stability.agg(median(F.round("sd_degree_rank", 9)).alias("_d"), median(F.round("sd_strength_rank", 9)).alias("_s"))

    def role(kind: str, limit: str) -> Column:
        central, stable = F.round(f"mean_{kind}_rank", 9) <= top, F.round(f"sd_{kind}_rank", 9) <= F.col(limit)
        return F.when(central & stable, "Stable central").when(central, "Dynamic central").when(stable, "Stable peripheral").otherwise("Dynamic peripheral")

    out = stability.join(limits).withColumns({"degree_role": role("degree", "_d"), "strength_role": role("strength", "_s")}).drop("_d", "_s")
    both = lambda name: (F.col("degree_role") == name) & (F.col("strength_role") == name)
    either = (F.col("degree_role") == "Dynamic central") | (F.col("strength_role") == "Dynamic central")
    combined = F.when(both("Stable central"), "Strong stable central").when(either, "Dynamic central candidate").when(both("Stable peripheral"), "Stable peripheral").when(both("Dynamic peripheral"), "Dynamic peripheral").otherwise("Mixed role")
    return out.withColumn("combined_role", combined)


# --- lifecycles: N16 - N19, N22 ----------------------------------------------------------------------------------


def episodes(history: DataFrame) -> DataFrame:
    """Runs of consecutive windows in which a pair is selected: number, first and last window and date, length."""
    pair = W.partitionBy("e1", "e2").orderBy("window_id")
    on = history.withColumn("_at", F.row_number().over(pair)).filter("selected")
    runs = on.withColumn("_run", F.col("_at") - F.row_number().over(pair))
    out = runs.groupBy("e1", "e2", "same_grp", "_run").agg(F.min("window_id").alias("start_window"), F.max("window_id").alias("end_window"), F.min("network_date").alias("start_date"), F.max("network_date").alias("end_date"), F.count(F.lit(1)).alias("length"))
    return out.withColumn("episode", F.row_number().over(W.partitionBy("e1", "e2").orderBy("start_window"))).drop("_run")


def lifecycle(history: DataFrame) -> DataFrame:
    """One row per pair: episodes, longest run, switches, entries, exits, strengths, signs, the bit string and the class."""
    rows = transitions(history)
    on, was = F.col("selected"), F.col("before")
    state = rows.groupBy("e1", "e2", "same_grp").agg(
        F.count(F.lit(1)).alias("total_windows"), _count(on).alias("windows_selected"), _count(was != on).alias("switch_count"), _count(~was & on).alias("entry_count"), _count(was & ~on).alias("exit_count"),
        F.min(_on("network_date")).alias("first_selected"), F.max(_on("network_date")).alias("last_selected"), F.avg(_on("weight")).alias("mean_when_selected"), F.avg(_on(F.abs("weight"))).alias("mean_abs_when_selected"),
        F.max(_on(F.abs("weight"))).alias("max_abs_when_selected"), _count(on & (F.col("weight") > 0)).alias("_pos"), _count(on & (F.col("weight") < 0)).alias("_neg"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_id", F.col("selected").cast("int").alias("b")))), lambda x: x["b"].cast("string")), "").alias("selection_sequence"),
    )
    first = F.struct(F.col("length"), -F.col("start_window"))
    runs = episodes(history).groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("n_episodes"), F.max("length").alias("longest_run"), F.max_by("start_date", first).alias("longest_run_start"), F.max_by("end_date", first).alias("longest_run_end"), F.avg(F.col("length").cast("double")).alias("mean_episode_length"))
    out = state.join(runs, ["e1", "e2"], "left").withColumns({"n_episodes": F.coalesce("n_episodes", F.lit(0)), "longest_run": F.coalesce("longest_run", F.lit(0))})
    out = out.withColumns({"persistence": ratio("windows_selected", "total_windows"), "longest_run_share": ratio("longest_run", "windows_selected"), "transition_rate": ratio(F.col("switch_count"), F.col("total_windows") - 1), "sign_consistency": ratio(F.greatest("_pos", "_neg"), "windows_selected")}).drop("_pos", "_neg")
    n, run = F.col("n_episodes"), F.col("longest_run")
    kind = F.when(F.col("persistence") >= PERSISTENT, "Persistent core").when(F.col("windows_selected") <= 2, "Rare").when((n == 1) & (run >= 3), "Regime-dependent").when(n >= 3, "Intermittent").when(n == 2, "Two-episode transitional").otherwise("Other")
    return out.withColumn("lifecycle_class", kind)


def lifecycle_classes(table: DataFrame, active_non_core: bool = False) -> DataFrame:
    """By relation and class: pairs, their share of the relation, mean persistence, mean transition rate."""
    rows = table.filter((F.col("persistence") < PERSISTENT) & (F.col("windows_selected") >= 3)) if active_non_core else table
    out = rows.withColumn("relation", relation()).groupBy("relation", "lifecycle_class").agg(F.count(F.lit(1)).alias("n_edges"), F.avg("persistence").alias("mean_persistence"), F.avg("transition_rate").alias("mean_transition_rate"), F.avg(F.col("n_episodes").cast("double")).alias("mean_episodes"))
    return out.withColumn("share", ratio(F.col("n_edges"), F.sum("n_edges").over(W.partitionBy("relation"))))


#: Columns of the classes that relation summaries count.
CLASS_COLUMNS = {"persistent_core": "Persistent core", "regime_dependent": "Regime-dependent", "intermittent": "Intermittent", "two_episode": "Two-episode transitional", "rare": "Rare"}


def relation_lifecycles(table: DataFrame, active_non_core: bool = False) -> DataFrame:
    """By relation: pairs, mean persistence, transition rate, episodes, longest run and its share, and the number and rate of each class.

    With active_non_core only pairs below the core that are selected in three windows or more.
    """
    rows = table.filter((F.col("persistence") < PERSISTENT) & (F.col("windows_selected") >= 3)) if active_non_core else table
    mean = lambda c: F.avg(F.col(c).cast("double"))
    out = rows.withColumn("relation", relation()).groupBy("relation").agg(
        F.count(F.lit(1)).alias("n_pairs"), mean("persistence").alias("mean_persistence"), mean("transition_rate").alias("mean_transition_rate"), mean("n_episodes").alias("mean_episodes"),
        mean("longest_run").alias("mean_longest_run"), mean("longest_run_share").alias("mean_longest_run_share"), *[_count(F.col("lifecycle_class") == v).alias(f"{c}_edges") for c, v in CLASS_COLUMNS.items()],
    )
    return out.withColumns({f"{c}_rate": ratio(f"{c}_edges", "n_pairs") for c in CLASS_COLUMNS})


def disagreements(classed: DataFrame, table: DataFrame) -> DataFrame:
    """The pairs that only the static or only the dynamic network has, with their lifecycle."""
    only = classed.filter(F.col("stability_class").isin("Static stable only", "Dynamic persistent only")).select("e1", "e2", "stability_class")
    return only.join(table, ["e1", "e2"], "left")


def class_counts(table: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """(class, n) of all classes, absent ones with 0."""
    all_of = table.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    counts = table.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return all_of.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))


# --- states and scores: N24 - N27 --------------------------------------------------------------------------------


def zscore(value: str) -> Column:
    """Standard score over all rows (sd with n - 1), null if nothing varies."""
    w = W.partitionBy()
    sd = F.stddev_samp(value).over(w)
    return F.when(sd > EPS, (F.col(value) - F.avg(value).over(w)) / sd)


def with_robust_z(df: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """df with value_robust_z: 0.6745 (x - median) / MAD, null if the MAD is 0."""
    mid = df.agg(*[median(v).alias(f"_m_{v}") for v in values])
    far = df.join(mid).agg(*[median(F.abs(F.col(v) - F.col(f"_m_{v}"))).alias(f"_d_{v}") for v in values])
    out = df.join(mid).join(far)
    out = out.withColumns({f"{v}_robust_z": F.when(F.col(f"_d_{v}") > EPS, 0.6745 * (F.col(v) - F.col(f"_m_{v}")) / F.col(f"_d_{v}")) for v in values})
    return out.drop(*[f"_m_{v}" for v in values], *[f"_d_{v}" for v in values])


STATE_Z = ("edge_count", "density", "mean_abs_weight", "same_edges", "cross_edges", "same_ratio", "turnover", "gross_edge_changes")
MOVES = ("net_edge_change", "common_edges", "lost_edges", "gained_edges", "gross_edge_changes", "jaccard", "turnover", "lost_same", "gained_same", "lost_cross", "gained_cross", "same_edge_changes", "cross_edge_changes", "cross_change_share")


def state_table(history: DataFrame) -> DataFrame:
    """One row per window: its summary, its transition (null in the first), z-scores and flags."""
    moves = turnover(history).select(F.col("date_to").alias("network_date"), *MOVES)
    out = window_summary(history).join(moves, "network_date", "left")
    out = out.withColumns({f"{c}_z": zscore(c) for c in STATE_Z})
    flag = lambda c, z: F.coalesce(F.col(c) > z, F.lit(False))
    return out.withColumns({"high_turnover_z1": flag("turnover_z", 1.0), "high_turnover_z1_5": flag("turnover_z", 1.5), "high_change_z1": flag("gross_edge_changes_z", 1.0)})


def change_scores(states: DataFrame) -> DataFrame:
    """Rewiring share, differences, z and robust z scores, the core score, flags, change type and source."""
    gross, net = F.col("gross_edge_changes"), F.col("net_edge_change")
    step = W.orderBy("network_date")
    rewired = F.when(gross > 0, 2 * F.least("lost_edges", "gained_edges") / gross).otherwise(0.0)
    df = states.select("window_id", "network_date", "turnover", "gross_edge_changes", "net_edge_change", "cross_edge_changes", "cross_change_share", rewired.alias("rewiring_share"), F.abs(net).alias("abs_edge_count_change"), *[(F.col(c) - F.lag(c).over(step)).alias(f"delta_{c}") for c in ("same_edges", "cross_edges", "mean_abs_weight", "same_ratio")])
    df = df.withColumns({f"{c}_z": zscore(c) for c in ("turnover", "gross_edge_changes", "abs_edge_count_change", "cross_edge_changes")})
    df = with_robust_z(df, ("turnover", "gross_edge_changes"))
    a, b = F.col("turnover_z"), F.col("gross_edge_changes_z")
    flag = lambda c: F.coalesce(c, F.lit(False))
    mostly = F.col("rewiring_share") >= 0.6
    kind = (
        F.when(gross.isNull(), "Initial network").when(gross == 0, "Stable support").when(mostly & (net > 0), "Rewiring with expansion").when(mostly & (net < 0), "Rewiring with contraction").when(mostly, "Pure rewiring")
        .when(net > 0, "Expansion-dominant").when(net < 0, "Contraction-dominant").otherwise("Balanced structural change")
    )
    cross = F.col("cross_change_share")
    source = F.when(cross.isNull(), "No change").when(cross >= 0.8, "Cross-industry dominated").when(cross <= 0.2, "Same-industry dominated").otherwise("Mixed")
    df = df.withColumns({"core_change_score": 0.5 * a + 0.5 * b, "max_core_z": F.greatest(a, b), "high_change_joint": flag((a >= 1) & (b >= 1)), "robust_high_turnover": flag(F.col("turnover_robust_z") >= 1.5), "robust_high_gross_change": flag(F.col("gross_edge_changes_robust_z") >= 1.5), "change_type": kind, "change_source": source})
    return df.withColumns({"high_change_moderate": flag(F.col("max_core_z") >= 1), "high_change_strong": flag(F.col("max_core_z") >= 1.5), "high_change_very_strong": flag(F.col("max_core_z") >= 2)})


def threshold_summary(scores: DataFrame, metrics: tuple[str, ...] = ("turnover", "gross_edge_changes", "abs_edge_count_change")) -> DataFrame:
    """(metric, mean, sd, median, mad, raw values at z = 1, 1.5 and 2)."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("m.*")
    mid = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), median("value").alias("median"))
    mad = long.join(mid, "metric").groupBy("metric").agg(median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    return mid.join(mad, "metric").select("metric", "mean", "sd", "median", "mad", *[(F.col("mean") + z * F.col("sd")).alias(n) for z, n in ((1.0, "z1_raw"), (1.5, "z1_5_raw"), (2.0, "z2_raw"))])


# --- regimes: N28 - N33 --------------------------------------------------------------------------------------------

REGIME_FEATURES = ("same_edges", "cross_edges", "mean_abs_weight")


def best_segments(x: np.ndarray, most: int, least: int) -> list[dict]:
    """For each number of segments: the borders of least squared error (earliest split on ties), rss and the BIC-style criterion."""
    n, d = x.shape
    sums, squares = np.vstack([np.zeros(d), np.cumsum(x, axis=0)]), np.concatenate([[0.0], np.cumsum((x**2).sum(axis=1))])
    cost = lambda a, b: max(squares[b] - squares[a] - float(((sums[b] - sums[a]) ** 2).sum()) / (b - a), 0.0)
    best = {(0, 0): (0.0, [])}
    out = []
    for r in range(1, most + 1):
        for end in range(r * least, n + 1):
            for start in range((r - 1) * least, end - least + 1):
                if (r - 1, start) in best:
                    total = best[r - 1, start][0] + cost(start, end)
                    if (r, end) not in best or total < best[r, end][0]:
                        best[r, end] = (total, best[r - 1, start][1] + [end])
        if (r, n) in best:
            rss, ends = best[r, n]
            k = r * d + r - 1
            out.append({"n_regimes": r, "rss": rss, "n_parameters": k, "bic_style": n * d * np.log(max(rss, 1e-12) / (n * d)) + k * np.log(n), "ends": ends})
    return out


def regimes(states: DataFrame, features: tuple[str, ...] = REGIME_FEATURES, most: int = 5, least: int = 3) -> DataFrame:
    """(window_id, network_date, regime, n_regimes, rss, bic_style) of the segmentation with the least criterion.

    One row per window, so the single task holds as many rows as there are windows.
    """
    rows = states.select("window_id", "network_date", *[F.col(f).cast("double").alias(f) for f in features])

    def segment(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("network_date")
        x = group[list(features)].to_numpy(float)
        sd = x.std(axis=0, ddof=1)
        found = best_segments((x - x.mean(axis=0)) / np.where(sd > EPS, sd, 1.0), most, least)
        top = min(found, key=lambda m: m["bic_style"])
        regime = 1 + np.searchsorted(np.array(top["ends"]), np.arange(len(group)), side="right")
        return pd.DataFrame({"window_id": group["window_id"].to_numpy(), "network_date": group["network_date"].to_numpy(), "regime": regime, "n_regimes": top["n_regimes"], "rss": top["rss"], "bic_style": top["bic_style"]})

    return apply_groups(rows, [], segment, "window_id int, network_date date, regime int, n_regimes int, rss double, bic_style double")


def regime_summary(states: DataFrame, assigned: DataFrame) -> DataFrame:
    """Means and sds by regime; turnover over windows whose predecessor is in the same regime."""
    rows = states.join(assigned.select("window_id", "regime"), "window_id")
    rows = rows.withColumn("_inside", F.lag("regime").over(W.orderBy("network_date")) == F.col("regime"))
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("regime").agg(
        F.min("network_date").alias("start_date"), F.max("network_date").alias("end_date"), F.count(F.lit(1)).alias("n_networks"), mean("edge_count").alias("mean_edge_count"), mean("same_edges").alias("mean_same_edges"), mean("cross_edges").alias("mean_cross_edges"),
        mean("same_ratio").alias("mean_same_ratio"), mean("mean_abs_weight").alias("mean_abs_weight"), F.avg(F.when(F.col("_inside"), F.col("turnover"))).alias("mean_within_turnover"), F.stddev_samp("edge_count").alias("sd_edge_count"), F.stddev_samp("cross_edges").alias("sd_cross_edges"), F.stddev_samp("mean_abs_weight").alias("sd_mean_abs_weight"),
    )


def change_points(states: DataFrame, assigned: DataFrame, features: tuple[str, ...] = REGIME_FEATURES) -> DataFrame:
    """Between successive regimes: deltas of means, the jump of the standardised means, and the boundary's transition."""
    z = states.withColumns({f"{f}_zz": zscore(f) for f in features}).join(assigned.select("window_id", "regime"), "window_id")
    mean = ("same_edges", "cross_edges", "edge_count", "mean_abs_weight", "same_ratio", *[f"{f}_zz" for f in features])
    by = z.groupBy("regime").agg(F.min("network_date").alias("start_date"), F.max("network_date").alias("end_date"), *[F.avg(F.col(c).cast("double")).alias(c) for c in mean])
    pair = by.alias("a").join(by.alias("b"), F.col("b.regime") == F.col("a.regime") + 1)
    norm = F.sqrt(sum((F.power(F.coalesce(F.col(f"b.{f}_zz") - F.col(f"a.{f}_zz"), F.lit(0.0)), F.lit(2.0)) for f in features), F.lit(0.0)))
    out = pair.select(F.col("a.regime").alias("previous_regime"), F.col("b.regime").alias("new_regime"), F.col("a.end_date").alias("previous_end"), F.col("b.start_date").alias("new_start"), *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"delta_{c}") for c in mean[:5]], norm.alias("jump_norm"))
    edge = states.select(F.col("network_date").alias("new_start"), *[F.col(c).alias(f"boundary_{c}") for c in ("turnover", "gross_edge_changes", "net_edge_change", "lost_edges", "gained_edges", "cross_change_share")])
    return out.join(edge, "new_start", "left")


def regime_persistence(history: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per regime and pair: persistence, core (0.8 or more), always, strengths when selected."""
    rows = history.join(F.broadcast(assigned.select("window_id", "regime")), "window_id")  # one row per window
    out = rows.groupBy("regime", "e1", "e2", "same_grp").agg(F.count(F.lit(1)).alias("n_windows"), _count(F.col("selected")).alias("windows_selected"), F.avg(_on("weight")).alias("mean_when_selected"), F.avg(_on(F.abs("weight"))).alias("mean_abs_when_selected"), F.max(_on(F.abs("weight"))).alias("max_abs_when_selected"))
    out = out.withColumn("persistence", ratio("windows_selected", "n_windows"))
    return out.withColumns({"is_core": F.col("persistence") >= PERSISTENT, "is_always": isclose("persistence", F.lit(1.0))})


def regime_structure(states: DataFrame, assigned: DataFrame, persistent: DataFrame) -> DataFrame:
    core, same, always = F.col("is_core"), F.col("same_grp"), F.col("is_always")
    by = persistent.groupBy("regime").agg(F.avg("persistence").alias("mean_edge_persistence"), _count(core).alias("n_core"), _count(core & same).alias("n_same_core"), _count(core & ~same).alias("n_cross_core"), _count(always).alias("n_always"), _count(always & same).alias("n_same_always"), _count(always & ~same).alias("n_cross_always"))
    return regime_summary(states, assigned).select("regime", "start_date", "end_date", "n_networks", "mean_edge_count", "mean_same_ratio", "mean_abs_weight").join(by, "regime").withColumn("same_share_of_core", ratio("n_same_core", "n_core"))


def regime_edge_change(persistent: DataFrame) -> DataFrame:
    """Adjacent regimes pair by pair: persistence before and after, its change, and the core transition."""
    side = lambda s: persistent.select("e1", "e2", "same_grp" if s == "before" else F.col("same_grp").alias("_g"), F.col("regime").alias(f"regime_{s}"), F.col("persistence").alias(f"persistence_{s}"), F.col("is_core").alias(f"core_{s}"), F.col("is_always").alias(f"always_{s}"))
    a, b = side("before").withColumn("_next", F.col("regime_before") + 1), side("after").drop("_g").withColumn("_next", F.col("regime_after"))
    out = a.join(b, ["e1", "e2", "_next"]).drop("_next").withColumn("delta_persistence", F.col("persistence_after") - F.col("persistence_before"))
    was, now = F.col("core_before"), F.col("core_after")
    return out.withColumns({"abs_delta": F.abs("delta_persistence"), "core_transition": F.when(was & now, "Persistent core").when(was, "Lost core").when(now, "Gained core").otherwise("Non-core both")})


def regime_change_summary(change: DataFrame) -> DataFrame:
    was, now, same, d = F.col("core_before"), F.col("core_after"), F.col("same_grp"), F.col("delta_persistence")
    out = change.groupBy("regime_before", "regime_after").agg(
        _count(was).alias("n_core_before"), _count(now).alias("n_core_after"), _count(was & now).alias("common_core"), _count(was & ~now).alias("lost_core"), _count(~was & now).alias("gained_core"), _count(was | now).alias("_union"),
        _count(was & ~now & same).alias("lost_same_core"), _count(was & ~now & ~same).alias("lost_cross_core"), _count(~was & now & same).alias("gained_same_core"), _count(~was & now & ~same).alias("gained_cross_core"),
        F.avg(d).alias("mean_delta"), F.avg("abs_delta").alias("mean_abs_delta"), _count(d <= -LARGE_SHIFT).alias("n_large_drop"), _count(d >= LARGE_SHIFT).alias("n_large_gain"),
    )
    return out.withColumn("core_jaccard", F.when(F.col("_union") == 0, 1.0).otherwise(ratio("common_core", "_union"))).drop("_union")


def by_class_order(df: DataFrame, column: str, classes: list[str], *then: Column) -> DataFrame:
    """df sorted by a column's place in a list of classes (others last), then by further columns."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column))
    return df.orderBy(F.when(place > 0, place).asc_nulls_last(), *then)


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


# --- regimes by node: N35 - N38 --------------------------------------------------------------------------------------

NODE_MEANS = ("degree", "strength", "same_degree", "cross_degree", "same_strength", "cross_strength", "degree_rank", "strength_rank")


def regime_nodes(ranked: DataFrame, assigned: DataFrame) -> DataFrame:
    rows = ranked.join(F.broadcast(assigned.select("window_id", "regime")), "window_id")
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("regime", "entity").agg(F.count(F.lit(1)).alias("n_networks"), *[mean(c).alias(f"mean_{c}") for c in NODE_MEANS], F.stddev_samp("degree").alias("sd_degree"), F.stddev_samp("strength").alias("sd_strength"), mean("top_degree").alias("top_degree_share"), mean("top_strength").alias("top_strength_share"))


def node_change(nodes: DataFrame) -> DataFrame:
    """Adjacent regimes node by node: deltas, rank improvements (before - after) and the rank shift."""
    side = lambda s: nodes.select("entity", F.col("regime").alias(f"regime_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in [*(f"mean_{m}" for m in NODE_MEANS), "top_degree_share", "top_strength_share"]])
    out = side("before").withColumn("_next", F.col("regime_before") + 1).join(side("after").withColumn("_next", F.col("regime_after")), ["entity", "_next"]).drop("_next")
    delta = lambda c: F.col(f"{c}_after") - F.col(f"{c}_before")
    out = out.select(
        "regime_before", "regime_after", "entity", *[f"mean_{m}_{s}" for m in ("degree", "strength", "degree_rank", "strength_rank") for s in ("before", "after")], *[delta(f"mean_{m}").alias(f"delta_mean_{m}") for m in NODE_MEANS[:6]],
        (-delta("mean_degree_rank")).alias("degree_rank_improvement"), (-delta("mean_strength_rank")).alias("strength_rank_improvement"), delta("top_degree_share").alias("delta_top_degree_share"), delta("top_strength_share").alias("delta_top_strength_share"),
    )
    return out.withColumn("rank_shift", F.sqrt(F.power("degree_rank_improvement", F.lit(2.0)) + F.power("strength_rank_improvement", F.lit(2.0))))


def edge_burden(change: DataFrame) -> DataFrame:
    """What a transition's edge changes add up to at each node; both ends are charged in full."""
    rows = change.withColumn("entity", F.explode(F.array("e1", "e2")))
    lost, gained, same, d = F.col("core_transition") == "Lost core", F.col("core_transition") == "Gained core", F.col("same_grp"), F.col("delta_persistence")
    total = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    out = rows.groupBy("regime_before", "regime_after", "entity").agg(
        _count(lost).alias("lost_core_incident"), _count(gained).alias("gained_core_incident"), _count(lost & same).alias("lost_same_core_incident"), _count(lost & ~same).alias("lost_cross_core_incident"), _count(gained & same).alias("gained_same_core_incident"), _count(gained & ~same).alias("gained_cross_core_incident"),
        total(d < 0, -d).alias("drop_burden"), total(d > 0, d).alias("gain_burden"), F.sum(F.abs(d)).alias("abs_burden"), total((d < 0) & ~same, -d).alias("cross_drop_burden"), total((d > 0) & ~same, d).alias("cross_gain_burden"), total(~same, F.abs(d)).alias("cross_abs_burden"),
        _count(d <= -LARGE_SHIFT).alias("major_drop_count"), _count(d >= LARGE_SHIFT).alias("major_gain_count"),
    )
    w = W.partitionBy("regime_before", "regime_after")
    out = out.withColumns({"total_core_change": F.col("lost_core_incident") + F.col("gained_core_incident"), "net_core_change": F.col("gained_core_incident") - F.col("lost_core_incident"), "net_shift": F.col("gain_burden") - F.col("drop_burden"), "abs_burden_share": ratio(F.col("abs_burden"), F.sum("abs_burden").over(w)), "cross_burden_ratio": ratio("cross_abs_burden", "abs_burden")})
    return out.withColumn("core_change_share", ratio(F.col("total_core_change"), F.sum("total_core_change").over(w)))


def contributors(changes: DataFrame, burden: DataFrame) -> DataFrame:
    """node_change with its burden and the node's transition mode."""
    lost, gained = F.col("lost_core_incident"), F.col("gained_core_incident")
    mode = F.when((lost == 0) & (gained == 0), "Limited core change").when((lost > 0) & (gained == 0), "Loss-dominated").when((gained > 0) & (lost == 0), "Gain-dominated").when((lost > 0) & (gained > 0), "Rewiring").otherwise("Mixed")
    return changes.join(burden, ["regime_before", "regime_after", "entity"], "left").withColumn("node_transition_mode", mode)


# --- representative windows: N39 ---------------------------------------------------------------------------------------


def compare_windows(history: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(window_a, window_b, e1, e2, change) of named window pairs: common, lost or gained edges."""
    wanted = F.broadcast(history.sparkSession.createDataFrame(pairs, "window_a int, window_b int"))  # the pairs asked for
    on = history.filter("selected").select("window_id", "e1", "e2")
    side = lambda s: on.join(wanted, F.col("window_id") == F.col(f"window_{s}")).select("window_a", "window_b", "e1", "e2", F.lit(True).alias(f"in_{s}"))
    both = side("a").join(side("b"), ["window_a", "window_b", "e1", "e2"], "full")
    return both.select("window_a", "window_b", "e1", "e2", F.when(F.col("in_a") & F.col("in_b"), "common").when(F.col("in_a"), "lost").otherwise("gained").alias("change"))


def window_pair_summary(compared: DataFrame) -> DataFrame:
    n = lambda kind: _count(F.col("change") == kind).alias(kind)
    return compared.groupBy("window_a", "window_b").agg(n("common"), n("lost"), n("gained"), ratio(_count(F.col("change") == "common"), F.count(F.lit(1))).alias("jaccard"))
