"""Parent pointers and tree contraction as joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.session import materialize

MAX_ROUNDS = 64


def pair_tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A symmetric hash of two id arrays: breaks ties between equal distances at random."""
    lo, hi = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = lo * np.uint64(0x9E3779B97F4A7C15) ^ (hi + np.uint64(0x632BE59BD9B4E019))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(2)).astype(np.int64)


def row_minimum(cost: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, cost, tie) of the least cost per row, ties by :func:`pair_tie`."""
    least = cost.min(1)
    rows, cols = np.nonzero(cost == least[:, None])
    tie = pair_tie(ids[rows], others[cols])
    order = np.lexsort((tie, rows))
    first = order[np.r_[True, rows[order][1:] != rows[order][:-1]]]
    return cols[first], least, tie[first]


def resolve_roots(links: DataFrame) -> DataFrame:
    """``(node, parent)`` -> ``(node, root)`` by pointer doubling; finished rows are not joined again."""
    table = materialize(links.select("node", "parent", F.lit(False).alias("done")))
    for _ in range(MAX_ROUNDS):
        active = table.where(~F.col("done"))
        if active.isEmpty():
            return table.select("node", F.col("parent").alias("root"))
        up = table.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col("done").alias("_d"))
        moved = active.join(up, active["parent"] == up["_n"], "left").select(
            "node", F.coalesce("_p", "parent").alias("parent"), F.coalesce("_d", F.lit(True)).alias("done"))
        table = materialize(table.where("done").unionByName(moved))
    raise RuntimeError("the parent pointers hold a cycle")


def hook(best: DataFrame) -> DataFrame:
    """Every component picked its least edge: ``(comp, other, a, b)`` -> ``(node, root)``.

    The picks form trees with one two-component cycle each, which is cut at the smaller.
    """
    edge = [F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")]
    picked = best.groupBy(*edge).agg(
        F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.first("other").alias("other"))
    links = picked.select(F.col("hi").alias("node"),
                          F.when(F.col("n") == 2, F.col("lo")).otherwise(F.col("other")).alias("parent"))
    return resolve_roots(links)


def relabel(rows: DataFrame, roots: DataFrame, column: str = "comp") -> DataFrame:
    """Replace ``column`` by its root where there is one."""
    joined = rows.join(roots.select(F.col("node").alias("_n"), "root"), rows[column] == F.col("_n"), "left")
    return joined.withColumn(column, F.coalesce("root", column)).drop("_n", "root")


def tree_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(row_id, comp)`` of a forest given as ``(a, b)``: contraction halves it every round."""
    comps = materialize(nodes.select("row_id", F.col("row_id").alias("comp")))
    open_ = materialize(edges.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    for _ in range(MAX_ROUNDS):
        if open_.isEmpty():
            return comps
        ends = (open_.select(F.col("ca").alias("comp"), F.col("cb").alias("other"), "a", "b")
                .unionByName(open_.select(F.col("cb").alias("comp"), F.col("ca").alias("other"), "a", "b")))
        least = F.min(F.struct(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")), "a", "b", "other")).alias("m")
        best = ends.groupBy("comp").agg(least).select("comp", "m.other", "m.a", "m.b")
        roots = materialize(hook(best))
        comps = materialize(relabel(comps, roots))
        open_ = relabel(relabel(open_, roots, "ca"), roots, "cb")
        open_ = materialize(open_.where(F.col("ca") != F.col("cb")))
    raise RuntimeError("the contraction did not end")
