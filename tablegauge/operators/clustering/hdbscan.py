"""Density-based clustering of a whole table: exact, as Spark jobs.

1. Core distances: block scan, each row keeps its nearest few distances.
2. Minimum spanning tree of the mutual reachability distances: rounds in which every
   component but the largest takes its least outgoing edge (at most log2 n rounds).  Known
   edges are those of the nearest rows; a row meets the whole table again only if what it has
   not seen may be less than the least known edge of its component.
3. ``entered``: the weight at which a point's component first has ``min_cluster_size``
   rows, found by growing from every point along at most that many least edges.
4. A tree edge is a true split if both its ends have entered below its weight.  Cutting
   those edges leaves the leaves of the cluster tree; only the splits, far fewer than the
   rows, reach the driver.
5. Points are placed on the tree, masses are summed by Spark, clusters are chosen.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.blocks import BLOCK_ROWS, Block, pair_squares, rough_squares, scan_cross, scan_pairs, tiles
from tablegauge.operators.clustering.condensed import ClusterTree, select_clusters
from tablegauge.operators.clustering.groups import MIN_CLUSTER_SIZE
from tablegauge.operators.clustering.links import MAX_ROUNDS, hook, pair_tie, relabel, tree_components
from tablegauge.operators.nearest import DENSE, LARGEST, Least, Nearest, square_bound
from tablegauge.session import broadcast_if_small, materialize

#: True splits the driver can order.
MAX_SPLITS = 1_000_000
#: Nearest rows that are kept of each row, as a multiple of those that its core distance needs.
LISTED = 2


def core_distances(df: DataFrame, min_samples: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row_id, features, core, near)``: the distance to the ``min_samples``-th nearest other row, and the nearest
    rows ``near`` as ``(d, v)``; no other row is nearer than the last of them."""
    listed = LISTED * min_samples

    def kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
        mine, other = Nearest(len(left.ids), listed), Nearest(len(right.ids), listed)
        for a, b, alike in tiles(left, right, same):
            x, y = left.x[a], right.x[b]
            rough, slack = rough_squares(x, y)
            if alike:
                np.fill_diagonal(rough, np.inf)
            mine.update(a, rough, slack, x, y, right.ids[b], right.ids[b])
            if not alike:
                (mine if same else other).update(b, rough.T, slack, y, x, left.ids[a], left.ids[a])
        parts = [pd.DataFrame({"id": block.ids, "d": list(found.distance), "v": list(found.id)})
                 for block, found in ((left, mine), (right, other))]
        return parts[0] if same else pd.concat(parts)

    scanned = scan_pairs(df, kernel, "id bigint, d array<double>, v array<bigint>", block_rows=block_rows)
    near = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "v"))))
    core = scanned.groupBy("id").agg(near.alias("near")).select(
        F.col("id").alias("row_id"), F.get("near.d", F.lit(min_samples - 1)).alias("core"),
        F.slice("near", 1, listed).alias("near"))
    return materialize(df.join(core, "row_id"))


def _outgoing_kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
    """The least edge of every row of the left block to another component in the right one, if it comes before
    the least known edge ``(w, tie)`` of the row's component."""
    found = Least(len(left.ids))
    found.cost, found.tie, own = left.extra["w"].astype(float), left.extra["tie"].copy(), left.extra["comp"]
    found.value = own.copy()
    for a, b, _ in tiles(left, right, False):
        x, y, core, far, ids, others, comp, theirs = (left.x[a], right.x[b], left.extra["core"][a], right.extra["core"][b],
                                                      left.ids[a], right.ids[b], own[a], right.extra["comp"][b])

        def weight(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            return np.maximum(np.sqrt(pair_squares(x, y, rows, cols)), np.maximum(core[rows], far[cols]))

        def tie(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            return pair_tie(ids[rows], others[cols])

        rough, slack = rough_squares(x, y)
        bound = square_bound(found.cost[a])
        near = rough <= np.minimum(bound * (1 + 1e-12) + 2 * slack, LARGEST)[:, None]
        if np.count_nonzero(near) <= DENSE * near.size:
            rows, cols = np.nonzero(near)
            kept = (comp[rows] != theirs[cols]) & (np.maximum(core[rows], far[cols]) <= found.cost[a][rows])
            rows, cols = rows[kept], cols[kept]
            if len(rows):
                found.offer(a, len(x), rows, cols, weight(rows, cols), tie, others, theirs)
            continue
        apart = comp[:, None] != theirs[None, :]
        reach = np.maximum(core[:, None], far[None, :])
        reach *= reach
        rough = np.where(apart, np.maximum(rough, reach, out=rough), np.inf)
        found.update(a, rough, slack, bound, weight, tie, others, theirs)
    out = pd.DataFrame({"row_id": left.ids, "w": found.cost, "tie": found.tie, "b": found.mate, "cb": found.value})
    return out[found.value != own]


@F.pandas_udf(T.LongType())
def _tie(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(pair_tie(a.to_numpy(), b.to_numpy()))


def _listed_edges(cores: DataFrame) -> DataFrame:
    """``(a, b, ca, cb, w, tie)``: the edges to the nearest rows; every row is a component."""
    far = cores.select(F.col("row_id").alias("v"), F.col("core").alias("far"))
    ends = cores.select("row_id", "core", F.inline("near")).where(F.col("row_id") != F.col("v")).join(far, "v")
    edges = ends.groupBy(F.least("row_id", "v").alias("a"), F.greatest("row_id", "v").alias("b")).agg(
        F.min(F.greatest("d", "core", "far")).alias("w")).where(F.col("w") < float("inf"))
    return edges.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), "w", _tie("a", "b").alias("tie"))


def _least_edges(edges: DataFrame) -> DataFrame:
    """``(comp, w, tie, a, b, other)``: the least known edge of every component."""
    ends = (edges.select(F.col("ca").alias("comp"), F.col("cb").alias("other"), "w", "tie", "a", "b")
            .unionByName(edges.select(F.col("cb").alias("comp"), F.col("ca").alias("other"), "w", "tie", "a", "b")))
    return ends.groupBy("comp").agg(F.min(F.struct("w", "tie", "a", "b", "other")).alias("m")).select("comp", "m.*")


def spanning_tree(cores: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(a, b, w, tie)``: the n - 1 edges of the minimum spanning tree.

    The largest component waits for the others to find it, so that few rows have to look for edges.
    """
    points = cores.select("row_id", "features", "core")
    edges = materialize(_listed_edges(cores))
    # ``unseen``: no edge of the row to another component that is not in ``edges`` comes before this level.
    last = F.element_at("near", -1)["d"]
    rows = materialize(cores.groupBy("row_id").agg(F.struct(
        F.min(last).alias("w"), F.lit(-1).cast("bigint").alias("tie")).alias("unseen")).withColumn("comp", F.col("row_id")))
    never = F.struct(F.lit(float("inf")).alias("w"), F.lit(-1).cast("bigint").alias("tie"))
    extent = points.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    tree = None
    for _ in range(MAX_ROUNDS):
        known = _least_edges(edges).select("comp", F.struct("w", "tie").alias("known"))
        largest = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comp").first()
        largest = largest["comp"] if largest else None
        asked = materialize(rows.where(F.col("comp") != largest).join(known, "comp", "left")
                            .where(F.col("unseen") < F.coalesce("known", never)).select("row_id", "comp", "known"))
        n_asked = asked.count()
        if n_asked:
            found = materialize(_least_outgoing(points, rows, asked, (n_asked, *extent), block_rows))
            fresh = found.select(F.least("row_id", "b").alias("a"), F.greatest("row_id", "b").alias("b"),
                                 F.when(F.col("row_id") < F.col("b"), F.col("comp")).otherwise(F.col("cb")).alias("ca"),
                                 F.when(F.col("row_id") < F.col("b"), F.col("cb")).otherwise(F.col("comp")).alias("cb"), "w", "tie")
            edges = edges.unionByName(fresh)
            levels = (asked.select("row_id", "known").join(found.select("row_id", F.struct("w", "tie").alias("_level")), "row_id", "left")
                      .select("row_id", F.coalesce("_level", "known", never).alias("_level")))
            rows = rows.join(levels, "row_id", "left").withColumn("unseen", F.coalesce("_level", "unseen")).drop("_level")
        best = materialize(_least_edges(edges).where(F.col("comp") != largest))
        if best.isEmpty():
            return tree
        picked = best.select("a", "b", "w", "tie").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        roots = hook(best)
        rows = materialize(relabel(rows, roots))
        edges = relabel(relabel(edges, roots, "ca"), roots, "cb")
        edges = materialize(edges.where(F.col("ca") != F.col("cb")))
    raise RuntimeError("the spanning tree did not end")


def _least_outgoing(points: DataFrame, rows: DataFrame, asked: DataFrame, extent: tuple[int, int, int],
                    block_rows: int) -> DataFrame:
    """``(row_id, comp, w, tie, b, cb)``: the least edge of the asked rows to another component, where it comes
    before the ``known`` one."""
    limits = asked.select("row_id", "comp", F.coalesce("known.w", F.lit(float("inf"))).alias("w"),
                          F.coalesce("known.tie", F.lit(2 ** 63 - 1)).alias("tie"))
    scanned = scan_cross(points.join(limits, "row_id"), points.join(rows.select("row_id", "comp"), "row_id"), _outgoing_kernel,
                         "row_id bigint, w double, tie bigint, b bigint, cb bigint",
                         extra_left=["core", "comp", "w", "tie"], extra_right=["core", "comp"], block_rows=block_rows,
                         extent=extent)
    least = scanned.groupBy("row_id").agg(F.min(F.struct("w", "tie", "b", "cb")).alias("m")).select("row_id", "m.*")
    return least.join(asked.select("row_id", "comp"), "row_id").select("row_id", "comp", "w", "tie", "b", "cb")


def _nearest_edges(tree: DataFrame, m: int) -> DataFrame:
    """``(node, near)``: the m least tree edges of every node, hubs ranked in slices first."""
    ends = (tree.select(F.col("a").alias("node"), "w", "tie", F.col("b").alias("v"))
            .unionByName(tree.select(F.col("b").alias("node"), "w", "tie", F.col("a").alias("v"))))
    order = [F.col("w"), F.col("tie")]
    sliced = ends.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(64)))
    kept = (sliced.withColumn("_r", F.row_number().over(Window.partitionBy("node", "_s").orderBy(*order)))
            .where(F.col("_r") <= m)
            .withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
            .where(F.col("_r") <= m))
    return materialize(kept.groupBy("node").agg(F.collect_list(F.struct("w", "tie", "v")).alias("near")))


def entering_weights(tree: DataFrame, m: int) -> DataFrame:
    """``(node, entered struct<w, tie>)``: the level at which a component of m rows is reached.

    Growing along least edges, m rows are reached after m - 1 joins; each row carries at
    most m short lists.
    """
    near = _nearest_edges(tree, m)
    grown = near.select("node", F.array("node").alias("seen"), F.col("near").alias("open"),
                        F.struct(F.lit(0.0).alias("w"), F.lit(0).cast("bigint").alias("tie")).alias("entered"))
    lists = near.select(F.col("node").alias("_v"), F.col("near").alias("_near"))
    for _ in range(m - 1):
        fresh = F.filter("open", lambda e: ~F.array_contains(F.col("seen"), e["v"]))
        picked = grown.withColumn("pick", F.array_min(fresh))
        joined = picked.join(lists, picked["pick.v"] == lists["_v"])
        grown = joined.select(
            "node", F.concat("seen", F.array("pick.v")).alias("seen"),
            F.concat("open", "_near").alias("open"),
            F.greatest("entered", F.struct(F.col("pick.w").alias("w"), F.col("pick.tie").alias("tie"))).alias("entered"))
    return materialize(grown.select("node", "entered"))


def _climb(points: DataFrame, tree: ClusterTree) -> DataFrame:
    """Replace ``node`` (a leaf) by the node the point belongs to, by doubling jumps."""
    n, parent, cut = len(tree.parent), tree.parent.copy(), tree.cut.copy()
    tables = []
    while (parent >= 0).any():
        tables.append(pd.DataFrame({"_n": np.arange(n), "_up": parent, "_cut": cut})[parent >= 0])
        top = np.where(parent >= 0, parent, 0)
        cut = np.where((parent >= 0) & (parent[top] >= 0), cut[top], np.inf)
        parent = np.where(parent >= 0, parent[top], -1)
    spark = points.sparkSession
    for table in reversed(tables):
        jumps = broadcast_if_small(spark.createDataFrame(table, "_n bigint, _up bigint, _cut double"), 3)
        points = points.join(jumps, points["node"] == jumps["_n"], "left")
        points = points.withColumn("node", F.when(F.col("_cut") <= F.col("w"), F.col("_up")).otherwise(F.col("node")))
        points = points.drop("_n", "_up", "_cut")
    return points


def hdbscan(df: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int | None = None,
            row_id: str = "row_id", features: str = "features", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``cluster`` 0.. or -1 for noise."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(features).alias("features"))
    if rows.limit(2 * min_cluster_size).count() < 2 * min_cluster_size:
        return df.withColumn("cluster", F.lit(-1))
    tree = materialize(spanning_tree(core_distances(rows, min_samples or min_cluster_size, block_rows), block_rows))
    entered = entering_weights(tree, min_cluster_size)
    ea = entered.select(F.col("node").alias("a"), F.col("entered").alias("ea"))
    eb = entered.select(F.col("node").alias("b"), F.col("entered").alias("eb"))
    level = F.struct("w", "tie")
    marked = materialize(tree.join(ea, "a").join(eb, "b").withColumn(
        "is_split", (F.col("ea") < level) & (F.col("eb") < level)).drop("ea", "eb"))
    leaves = tree_components(rows, marked.where(~F.col("is_split")))
    splits = marked.where("is_split")
    for end in ("a", "b"):
        splits = splits.join(leaves.select(F.col("row_id").alias(end), F.col("comp").alias(f"l{end}")), end)
    found = splits.select("w", "la", "lb", "tie").limit(MAX_SPLITS + 1).collect()
    if len(found) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits; cluster bags of the table instead")
    names = sorted({r["la"] for r in found} | {r["lb"] for r in found})
    if not names:
        return df.withColumn("cluster", F.lit(-1))
    number = {name: i for i, name in enumerate(names)}
    spark = df.sparkSession
    leaf_numbers = broadcast_if_small(spark.createDataFrame(
        list(number.items()), "comp bigint, node bigint"), 2)
    points = (leaves.join(leaf_numbers, "comp").drop("comp")
              .join(entered.select(F.col("node").alias("row_id"), F.col("entered.w").alias("w")), "row_id"))
    placed: list[DataFrame] = []

    def sums(cluster_tree: ClusterTree) -> pd.DataFrame:
        placed.append(materialize(_climb(points, cluster_tree)))
        density = F.when(F.col("w") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("w")))
        per_node = placed[0].groupBy("node").agg(F.count(F.lit(1)).alias("points"), F.sum(density).alias("density"))
        out = pd.DataFrame({"points": 0, "density": 0.0}, index=range(len(cluster_tree.parent)))
        for r in per_node.collect():  # one row per tree node
            out.loc[r["node"], ["points", "density"]] = r["points"], r["density"]
        return out

    chosen = select_clusters(len(names), [(r["w"], number[r["la"]], number[r["lb"]], r["tie"]) for r in found], sums)
    labels = broadcast_if_small(spark.createDataFrame(pd.DataFrame(
        {"node": np.arange(len(chosen.number)), "cluster": chosen.number}), "node bigint, cluster int"), 2)
    result = placed[0].join(labels, "node").select(F.col("row_id").alias(row_id), "cluster")
    return df.join(result, row_id)
