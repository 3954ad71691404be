"""Graphs as (nodes, edges) frames, their measures and their trees.

Edges are (e1, e2, weight) with e1 < e2, nodes (entity, grp); isolated nodes
stay in every result.  Degrees, strengths, densities, mixing and assortativity
are relational.  Shortest-path measures and the spanning tree of one graph run
as a grouped function, one task per graph.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..shipping import apply_groups, checkpoint_folder, map_batches


#: Nodes from which one task searches shortest paths.
SOURCES = 256


def distance(weight: str = "weight"):
    return F.sqrt(2 * (1 - F.col(weight)))


def threshold_edges(pairs: DataFrame, least: float, absolute: bool = False, name: str = "weight") -> DataFrame:
    """(e1, e2, weight, distance) of the pairs at or above the threshold."""
    value = F.abs(F.col(name)) if absolute else F.col(name)
    return pairs.filter(value >= least).select("e1", "e2", F.col(name).alias("weight"), F.sqrt(2 * (1 - F.col(name))).alias("distance"))


def threshold_sensitivity(pairs: DataFrame, thresholds: list[float], absolute: bool = False, name: str = "weight") -> DataFrame:
    """(threshold, n_edges, density) in one pass over the pairs; density over all pairs given."""
    value = F.abs(F.col(name)) if absolute else F.col(name)
    counts = pairs.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(value >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("n_edges"), ratio(f"c{i}", "n").alias("density")) for i, t in enumerate(thresholds)])
    return counts.select(F.inline(rows))


def distance_graph(pairs: DataFrame, name: str = "weight") -> DataFrame:
    return pairs.select("e1", "e2", F.col(name).alias("weight"), F.sqrt(2 * (1 - F.col(name))).alias("distance"))


def incidence(edges: DataFrame, *columns: str) -> DataFrame:
    """Every edge seen from both ends: (entity, other, columns)."""
    one = edges.select(F.col("e1").alias("entity"), F.col("e2").alias("other"), *columns)
    return one.unionByName(edges.select(F.col("e2").alias("entity"), F.col("e1").alias("other"), *columns))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, degree, degree_centrality, weighted_degree, strength, mean_weight, isolated, leaf)."""
    by = incidence(edges, "weight").groupBy("entity").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"), F.sum(F.abs("weight")).alias("strength"), F.avg("weight").alias("mean_weight"))
    n = nodes.agg((F.count(F.lit(1)) - 1).alias("n1"))
    out = nodes.select("entity").join(by, "entity", "left").join(n)
    degree = F.coalesce("degree", F.lit(0))
    return out.select(
        "entity", degree.alias("degree"), F.try_divide(degree.cast("double"), F.nullif(F.col("n1").cast("double"), F.lit(0.0))).alias("degree_centrality"),
        F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"), "mean_weight", (degree == 0).alias("isolated"), (degree == 1).alias("leaf"),
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity, component, component_size): the component's smallest entity names it.  Labels and pointers are halved until nothing changes."""
    label = settled(nodes.select("entity", F.col("entity").alias("component")))
    links = settled(incidence(edges).select("entity", "other"))
    while True:
        near = links.join(label.select(F.col("entity").alias("other"), "component"), "other").groupBy("entity").agg(F.min("component").alias("near"))
        low = label.join(near, "entity", "left").select("entity", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = low.join(low.select(F.col("entity").alias("low"), F.col("low").alias("lower")), "low").select("entity", "component", F.col("lower").alias("new"))
        jump = settled(jump)
        changed = jump.filter("new <> component").limit(1).count()
        label = jump.select("entity", F.col("new").alias("component"))
        if not changed:
            break
    return label.withColumn("component_size", F.count(F.lit(1)).over(W.partitionBy("component")))


def settled(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def enrich(edges: DataFrame, dim: DataFrame, default: str = "unknown") -> DataFrame:
    """Edges with both ends' groups (a default where the dimension lacks them), same_grp and the sign's name."""
    side = lambda k: F.broadcast(dim.select(F.col("entity").alias(f"e{k}"), F.col("grp").alias(f"grp_{k}")))  # noqa: E731  one row per node of the graph
    out = edges.join(side(1), "e1", "left").join(side(2), "e2", "left")
    out = out.withColumns({"grp_1": F.coalesce("grp_1", F.lit(default)), "grp_2": F.coalesce("grp_2", F.lit(default))})
    return out.withColumns({"same_grp": F.col("grp_1") == F.col("grp_2"), "sign": F.when(F.col("weight") > 0, "positive").otherwise("negative")})


def assortativity(edges: DataFrame, dim: DataFrame) -> DataFrame:
    """(assortativity) by Newman's mixing matrix of groups; null without edges or with a single group."""
    both = enrich(edges, dim).select(F.explode(F.array(F.struct(F.col("grp_1").alias("x"), F.col("grp_2").alias("y")), F.struct(F.col("grp_2").alias("x"), F.col("grp_1").alias("y")))).alias("m")).select("m.*")
    total = both.agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    margin = both.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    ab = F.col("squares") / (F.col("n") * F.col("n"))
    return total.join(margin).select(F.try_divide(ratio("same", "n") - F.try_divide(F.col("squares"), F.nullif(F.col("n") * F.col("n"), F.lit(0.0))), F.nullif(1 - F.when(F.col("n") > 0, ab), F.lit(0.0))).alias("assortativity"))


def network_summary(nodes: DataFrame, edges: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """One row: n_nodes, n_edges, density, mean and largest degree, components, isolates (and same-group edges and ratio)."""
    by = node_degrees(nodes, edges).join(components(nodes, edges), "entity")
    out = by.agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg(F.col("degree").cast("double")).alias("mean_degree"),
        F.max("degree").alias("max_degree"), F.countDistinct("component").alias("n_components"), F.count_if("isolated").alias("n_isolated"),
    )
    out = out.withColumn("density", F.try_divide(2.0 * F.col("n_edges"), F.nullif((F.col("n_nodes") * (F.col("n_nodes") - 1)).cast("double"), F.lit(0.0))))
    if dim is not None:
        same = enrich(edges, dim).agg(F.count_if("same_grp").alias("same_edges"), F.avg(F.col("same_grp").cast("double")).alias("same_ratio"))
        out = out.join(same).join(assortativity(edges, dim))
    return out


def union_graph(history: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """(e1, e2, weight, n_windows): the mean weight of every edge selected in any of the windows."""
    rows = history.filter("selected") if ids is None else history.filter(F.col("selected") & F.col("window_id").isin(ids))
    return rows.groupBy("e1", "e2").agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n_windows"))


def common_graph(history: DataFrame, ids: list[int]) -> DataFrame:
    """Edges selected in all of the windows."""
    return union_graph(history, ids).filter(F.col("n_windows") == len(set(ids))).select("e1", "e2", "weight")


# --- one graph in one task -----------------------------------------------------------------------------------


TREE = "e1 string, e2 string, weight double, distance double"


def _tree_rows(rows: pd.DataFrame) -> pd.DataFrame:
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for r in rows.sort_values(["distance", "e1", "e2"]).itertuples(index=False):
        a, b = root(r.e1), root(r.e2)
        if a != b:
            parent[a] = b
            kept.append((r.e1, r.e2, r.weight, r.distance))
    return pd.DataFrame(kept, columns=["e1", "e2", "weight", "distance"])


def spanning_tree(pairs: DataFrame, name: str = "weight") -> DataFrame:
    """(e1, e2, weight, distance) of the minimum spanning tree by distance; equal distances in order of (e1, e2)."""
    return apply_groups(map_batches(distance_graph(pairs, name), _forest, TREE), [], _tree_rows, TREE)


def _forest(batches):
    """The spanning forest of a partition's pairs; the tree of all pairs is the tree of the partitions' forests."""
    held = None
    for batch in batches:
        held = _tree_rows(batch if held is None else pd.concat([held, batch]))
    if held is not None:
        yield held


def spanning_trees(history: DataFrame) -> DataFrame:
    """(window_id, e1, e2, weight, distance) of each window's minimum spanning tree over all its pairs that have a weight."""
    rows = history.filter("weight IS NOT NULL").select("window_id", "e1", "e2", "weight", distance().alias("distance"))
    return apply_groups(rows, ["window_id"], lambda g: _tree_rows(g).assign(window_id=g["window_id"].iloc[0]), f"window_id int, {TREE}")


def tree_survival(trees: DataFrame) -> DataFrame:
    """(window_from, window_to, n_edges, n_common, survival): the share of a tree's edges that the next window's tree keeps."""
    numbers = trees.groupBy("window_id").agg(F.count(F.lit(1)).alias("n_edges"))
    numbers = numbers.withColumn("window_to", F.lead("window_id").over(W.orderBy("window_id"))).filter("window_to IS NOT NULL")  # a row per window
    keys = trees.select("window_id", "e1", "e2")
    common = keys.join(numbers, "window_id").join(keys.select(F.col("window_id").alias("window_to"), "e1", "e2"), ["window_to", "e1", "e2"]).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_common"))
    out = numbers.join(common, "window_id", "left").withColumn("n_common", F.coalesce("n_common", F.lit(0)))
    return out.select(F.col("window_id").alias("window_from"), "window_to", "n_edges", "n_common", ratio("n_common", "n_edges").alias("survival"))


def tree_length(tree: DataFrame) -> DataFrame:
    return tree.agg(F.avg("distance").alias("tree_length"))


def _paths(names: list[str], near: dict[str, list[tuple[str, float]]], source: str):
    """Distances, predecessors, path counts and finishing order from a source."""
    length, count, before, order = {source: 0.0}, {source: 1.0}, {x: [] for x in names}, []
    queue, done = [(0.0, source)], set()
    while queue:
        d, x = heapq.heappop(queue)
        if x in done:
            continue
        done.add(x)
        order.append(x)
        for y, step in near[x]:
            new = d + step
            if y not in length or new < length[y] - 1e-12:
                length[y], count[y], before[y] = new, count[x], [x]
                heapq.heappush(queue, (new, y))
            elif y not in done and abs(new - length[y]) <= 1e-12:
                count[y] += count[x]
                before[y].append(x)
    return length, count, before, order


def _central(rows: pd.DataFrame, weighted: bool) -> pd.DataFrame:
    """What the sources of one block give: closeness of each, and their share of every node's betweenness."""
    names = sorted(rows["entity"].unique())
    near: dict[str, list[tuple[str, float]]] = {x: [] for x in names}
    for r in rows.dropna(subset=["other"]).itertuples(index=False):
        near[r.entity].append((r.other, r.distance if weighted else 1.0))
    between, close, n = dict.fromkeys(names, 0.0), {}, len(names)
    block, blocks = int(rows["block"].iloc[0]), int(rows["blocks"].iloc[0])
    for s in names[block::blocks]:
        length, count, before, order = _paths(names, near, s)
        total, reach = sum(length.values()), len(length)
        close[s] = (reach - 1) / total * (reach - 1) / (n - 1) if total > 0 and n > 1 else 0.0
        owed = dict.fromkeys(names, 0.0)
        for x in reversed(order):
            for y in before[x]:
                owed[y] += count[y] / count[x] * (1 + owed[x])
            if x != s:
                between[x] += owed[x]
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return pd.DataFrame({"entity": names, "betweenness": [between[x] * scale for x in names], "closeness": [close.get(x) for x in names]})


def path_centrality(nodes: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    """(entity, betweenness, closeness): normalised betweenness, and closeness scaled by the share of nodes reached; by distance or by hops.

    The graph goes to a task for every SOURCES of its nodes, which searches from these.
    """
    length = "distance" if "distance" in edges.columns else F.lit(1.0).alias("distance")
    ends = incidence(edges.select("e1", "e2", length), "distance")
    blocks = -(-nodes.count() // SOURCES) or 1
    rows = nodes.select("entity").join(ends, "entity", "left").withColumn("blocks", F.lit(blocks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = apply_groups(rows, ["block"], lambda g: _central(g, weighted), "entity string, betweenness double, closeness double")
    return parts.groupBy("entity").agg(F.sum("betweenness").alias("betweenness"), F.max("closeness").alias("closeness"))


def node_metrics(nodes: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    return node_degrees(nodes, edges).join(path_centrality(nodes, edges, weighted), "entity").join(components(nodes, edges), "entity")


def _layout(rows: pd.DataFrame, scale: float) -> pd.DataFrame:
    near: dict[str, list[tuple[str, float]]] = {}
    for r in rows.itertuples(index=False):
        near.setdefault(r.e1, []).append((r.e2, r.distance))
        near.setdefault(r.e2, []).append((r.e1, r.distance))
    top = min(near, key=lambda x: (-len(near[x]), x))
    order, parent = [top], {top: None}
    for x in order:
        for y, _ in sorted(near[x]):
            if y not in parent:
                parent[y] = x
                order.append(y)
    children = {x: [y for y in order if parent[y] == x] for x in order}
    leaves: dict[str, int] = {}
    for x in reversed(order):
        leaves[x] = sum(leaves[y] for y in children[x]) or 1
    place, sector = {top: (0.0, 0.0, 0)}, {top: (0.0, 2 * math.pi)}
    for x in order:
        at, (low, high) = 0, sector[x]
        for y in children[x]:
            a = low + (high - low) * at / leaves[x]
            at += leaves[y]
            b = low + (high - low) * at / leaves[x]
            step = scale * next(d for z, d in near[x] if z == y)
            sector[y] = (a, b)
            place[y] = (place[x][0] + step * math.cos((a + b) / 2), place[x][1] + step * math.sin((a + b) / 2), place[x][2] + 1)
    return pd.DataFrame([(x, *place[x]) for x in order], columns=["entity", "x", "y", "level"])


def tree_layout(tree: DataFrame, scale: float = 5.0) -> DataFrame:
    """(entity, x, y, level): root of largest degree, sectors by leaf count, edges as long as their distance; also gives occupation layers."""
    return apply_groups(tree, [], lambda g: _layout(g, scale), "entity string, x double, y double, level int")


def occupation_layer(tree: DataFrame) -> DataFrame:
    return tree_layout(tree).agg(F.avg(F.col("level").cast("double")).alias("mean_layer"))
