"""Ward clustering of a whole table: exact, by rounds of mutual nearest neighbours.

Ward's cost is reducible: two clusters that are each other's cheapest partner will be
merged whatever happens elsewhere, so all such pairs may merge at once.  A round is one
block scan over the remaining clusters (size and centroid are all the cost needs) and one
aggregation; the last few thousand clusters are finished in memory, as their rounds would
cost more than their distances.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.vectors import as_vector
from tablegauge.operators.blocks import BLOCK_ROWS, PANEL_BYTES, Block, pair_squares, rough_squares, scan_pairs, tiles
from tablegauge.operators.clustering.groups import ward_merges
from tablegauge.operators.clustering.links import pair_tie, resolve_roots
from tablegauge.operators.nearest import Least
from tablegauge.session import materialize

#: Clusters that are merged in memory at the end; those that are so few whatever their width.
FINISH_NODES, FEW_NODES = 4096, 64


def _cheapest_kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
    mine, other = Least(len(left.ids)), Least(len(right.ids))

    def meet(found: Least, here: Block, there: Block, a: slice, b: slice, rough: np.ndarray, slack: float) -> None:
        x, y, n, m = here.x[a], there.x[b], here.extra["size"][a], there.extra["size"][b]
        ids, others = here.ids[a], there.ids[b]

        def cost(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            return pair_squares(x, y, rows, cols) * (n[rows] * m[cols] / (n[rows] + m[cols]))

        found.update(a, rough, slack * n, found.cost[a], cost, lambda rows, cols: pair_tie(ids[rows], others[cols]), others, others)

    for a, b, alike in tiles(left, right, same):
        n, m = left.extra["size"][a][:, None], right.extra["size"][b][None, :]
        rough, slack = rough_squares(left.x[a], right.x[b])
        rough *= n * m / (n + m)
        if alike:
            np.fill_diagonal(rough, np.inf)
        meet(mine, left, right, a, b, rough, slack)
        if not alike:
            meet(mine if same else other, right, left, b, a, rough.T, slack)

    out = [pd.DataFrame({"id": block.ids, "mate": found.mate, "cost": found.cost, "tie": found.tie})
           for found, block in ((mine, left), (other, right))][:1 if same else 2]
    found = pd.concat(out)
    return found[np.isfinite(found["cost"])]


def _merge_round(nodes: DataFrame, n: int, block_rows: int) -> DataFrame:
    """Merge all mutual cheapest pairs; merged nodes carry ``child`` and their height ``peak``."""
    scanned = scan_pairs(nodes, _cheapest_kernel, "id bigint, mate bigint, cost double, tie bigint",
                         extra=["size"], block_rows=block_rows, extent=(1, n))
    best = (scanned.groupBy("id").agg(F.min(F.struct("cost", "tie", "mate")).alias("b"))
            .select("id", "b.cost", "b.mate"))
    mutual = (best.groupBy(F.least("id", "mate").alias("lo"), F.greatest("id", "mate").alias("hi"))
              .agg(F.count(F.lit(1)).alias("n"), F.max("cost").alias("cost")).where("n = 2"))
    targets = mutual.select(F.explode(F.array("lo", "hi")).alias("_id"), F.col("lo").alias("target"), "cost")
    joined = nodes.join(targets, nodes["row_id"] == targets["_id"], "left")
    return materialize(
        joined.groupBy(F.coalesce("target", "row_id").alias("node")).agg(
            vector_to_array(Summarizer.mean(as_vector("features"), F.col("size"))).alias("features"),
            F.sum("size").alias("size"),
            F.greatest(F.max("peak"), F.coalesce(F.max("cost"), F.lit(0.0))).alias("peak"),
            F.max(F.when(F.col("row_id") != F.col("target"), F.col("row_id"))).alias("child"))
        .withColumnRenamed("node", "row_id"))


def ward_tree(df: DataFrame, finish: int = FINISH_NODES, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list]:
    """(merges of the distributed rounds, merges of the end): child, parent, height, step."""
    nodes = materialize(df.select("row_id", "features", F.lit(1.0).alias("size"), F.lit(0.0).alias("peak")))
    merges = df.sparkSession.createDataFrame([], "child bigint, parent bigint, height double, step bigint")
    # Every round merges the cheapest pair of all at least, so the loop ends.
    for step in itertools.count():
        n = nodes.count()
        if step == 0 and n > FEW_NODES:
            width = nodes.agg(F.max(F.size("features"))).first()[0]
            finish = min(finish, max(FEW_NODES, PANEL_BYTES // (8 * max(1, width))))
        # A round puts rows of one id together; null ids stay with the rounds.
        if n <= finish and (n <= FEW_NODES or nodes.agg(F.count_distinct("row_id")).first()[0] == n):
            break
        merged = _merge_round(nodes, n, block_rows)
        merges = merges.unionByName(merged.where("child is not null").select(
            "child", F.col("row_id").alias("parent"), F.col("peak").alias("height"),
            F.lit(step).cast("bigint").alias("step")))
        nodes = merged.drop("child")
    last = nodes.orderBy("row_id").collect()  # at most ``finish`` rows
    x, peak = np.array([r["features"] for r in last], dtype=float), np.array([r["peak"] for r in last])
    tail = []
    for number, (height, a, b) in enumerate(ward_merges(x, np.array([r["size"] for r in last]))):
        a, b = int(a), int(b)
        peak[a] = max(height, peak[a], peak[b])
        tail.append((last[b]["row_id"], last[a]["row_id"], float(peak[a]), 10 ** 6 + number))
    return merges, tail


def ward(df: DataFrame, k: int, row_id: str = "row_id", features: str = "features",
         finish: int = FINISH_NODES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``cluster`` 0..k-1: the tree cut where k clusters remain."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(features).alias("features"))
    merges, tail = ward_tree(rows, finish, block_rows)
    # The k - 1 highest merges are undone; an ancestor is never below its descendants.
    top = merges.orderBy(F.desc("height"), F.desc("step")).limit(max(0, k - 1)).collect()
    ranked = sorted([tuple(r) for r in top] + tail, key=lambda m: (m[2], m[3]), reverse=True)
    undone = [m[0] for m in ranked[:k - 1]]
    spark = df.sparkSession
    ends = spark.createDataFrame([m[:2] for m in tail if m[0] not in set(undone)], "child bigint, parent bigint")
    links = merges.where(~F.col("child").isin(undone)).select("child", "parent").unionByName(ends)
    roots = resolve_roots(links.select(F.col("child").alias("node"), "parent"))
    labelled = df.join(roots.select(F.col("node").alias(row_id), "root"), row_id, "left")
    labelled = labelled.withColumn("_root", F.coalesce("root", row_id)).drop("root")
    # k roots: the undone children, and whoever absorbed last.
    found = sorted(r[0] for r in labelled.select("_root").distinct().limit(k + 1).collect())
    if len(found) > k:
        raise RuntimeError("the tree was not cut into the wanted number of clusters")
    numbers = spark.createDataFrame(list(zip(found, range(len(found)))), "_root bigint, cluster int")
    return labelled.join(F.broadcast(numbers), "_root").drop("_root")
