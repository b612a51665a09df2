"""Clusterings of many small groups (bags): one task call per group, groups bounded in size.

The functions below see one bag of at most a few thousand rows; everything across bags
(drawing, counting, scoring, averaging) is done by Spark.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.blocks import distances, group_extent, group_sizes
from tablegauge.operators.clustering.lloyd import ROUNDS, first_centers, moved, nearest, sums
from tablegauge.session import match_groups, materialize, spread

#: Most rows of a group that one task clusters; larger groups go through the whole-table operators.
MAX_GROUP_ROWS = 5_000

# Defaults of the density-based clustering and of the kernel width.
MIN_CLUSTER_SIZE = 5
RBF_GAMMA = 1.0


def z_scores(x: np.ndarray) -> np.ndarray:
    std = x.std(0)
    return (x - x.mean(0)) / np.where(std == 0, 1.0, std)


def kmeans_labels(x: np.ndarray, k: int, seed: int, n_init: int = 10, rounds: int = ROUNDS) -> np.ndarray:
    """Best of ``n_init`` starts, by the steps of the whole-table operator."""
    centers, middle = first_centers(x, min(k, len(x)), n_init, seed)
    costs, active = np.full(n_init, np.inf), np.arange(n_init)
    for _ in range(rounds):
        now = centers[active]
        found = sums(x - middle, now)
        new, still = moved(found, now)
        costs[active] = found.reshape(*now.shape[:2], -1)[..., -1].sum(1)
        centers[active] = np.where(still[:, None, None], now, new)
        active = active[~still]
        if not len(active):
            break
    return nearest(x, centers[costs.argmin()] + middle)


def ward_merges(x: np.ndarray, sizes: np.ndarray, square: np.ndarray | None = None) -> np.ndarray:
    """Rows (height, kept, absorbed): every merge of weighted points, cheapest chain first.

    Follows nearest-neighbour chains, so it needs no priority queue and n^2 distances once;
    ``square`` has their squares if they are known.
    """
    n, size = len(x), sizes.astype(float).copy()
    cost = distances(x, x, squared=True) if square is None else square.copy()
    for row, own in zip(cost, size):
        row *= own * size / (own + size)
    np.fill_diagonal(cost, np.inf)
    dead, chain, merges = np.zeros(n, bool), [], []
    total, weight, updated, part = np.empty((4, n))
    while len(merges) < n - 1:
        if not chain:
            chain = [int(dead.argmin())]
        while True:
            tip = chain[-1]
            row = cost[tip]
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        a, b = min(tip, near), max(tip, near)
        height = cost[a, b]
        merges.append((height, a, b))
        np.add(size[a] + size[b], size, out=total)
        np.multiply(np.add(size[a], size, out=weight), cost[a], out=updated)
        updated += np.multiply(np.add(size[b], size, out=weight), cost[b], out=part)
        updated -= np.multiply(size, height, out=part)
        updated /= total
        dead[b] = True
        size[a] += size[b]
        updated[dead] = np.inf
        updated[a] = np.inf
        cost[a], cost[:, a] = updated, updated
        cost[:, b] = np.inf
    return np.array(merges, dtype=float).reshape(-1, 3)


def forest_labels(n: int, edges: np.ndarray) -> np.ndarray:
    """Component number of every point, 0.. in order of first appearance."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in np.asarray(edges).astype(np.int64).tolist():
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def ward_labels(x: np.ndarray, k: int, square: np.ndarray | None = None) -> np.ndarray:
    merges = ward_merges(x, np.ones(len(x)), square)
    merges = merges[np.argsort(merges[:, 0], kind="stable")]
    return forest_labels(len(x), merges[:max(0, len(x) - k), 1:])


def spectral_labels(x: np.ndarray, k: int, seed: int, gamma: float = RBF_GAMMA, square: np.ndarray | None = None) -> np.ndarray:
    """k-means on the leading eigenvectors of the normalised RBF affinity."""
    affinity = np.exp(-gamma * (distances(x, x, squared=True) if square is None else square))
    np.fill_diagonal(affinity, 0.0)
    degree = affinity.sum(0)
    root = np.where(degree > 0, np.sqrt(degree), 1.0)
    laplacian = -affinity / root[:, None] / root[None, :]
    np.fill_diagonal(laplacian, 1.0)
    _, vectors = np.linalg.eigh(laplacian)
    return kmeans_labels(vectors[:, :k] / root[:, None], k, seed)


def reachability_tree(x: np.ndarray, min_samples: int, square: np.ndarray | None = None) -> np.ndarray:
    """Minimum spanning tree rows (weight, a, b) of the mutual reachability distances."""
    d = distances(x, x) if square is None else np.sqrt(square)
    n = len(x)
    core = np.partition(d, min(min_samples, n - 1), axis=1)[:, min(min_samples, n - 1)]
    d = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    # ``best`` is infinite for the points that are in the tree.
    outside, best, source = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, int)
    closer, current, edges = np.empty(n, bool), 0, []
    outside[0] = False
    for _ in range(n - 1):
        row = d[current]
        np.less(row, best, out=closer)
        closer &= outside
        np.copyto(best, row, where=closer)
        source[closer] = current
        nxt = int(best.argmin())
        edges.append((best[nxt], source[nxt], nxt))
        outside[nxt], best[nxt], current = False, np.inf, nxt
    tree = np.array(edges).reshape(-1, 3)
    return tree[np.argsort(tree[:, 0], kind="stable")]


def hdbscan_labels(x: np.ndarray, min_cluster_size: int = MIN_CLUSTER_SIZE,
                   min_samples: int | None = None, square: np.ndarray | None = None) -> np.ndarray:
    """Density-based clusters by greatest excess of mass; -1 is noise."""
    from tablegauge.operators.clustering.condensed import select_clusters

    n = len(x)
    if n < 2 * min_cluster_size:
        return np.full(n, -1)
    tree = reachability_tree(x, min_samples or min_cluster_size, square)
    # Kruskal: note when each point's component first reaches the cluster size, and the
    # edges that join two components which both have.
    root, members = list(range(n)), [[i] for i in range(n)]
    entered, splits, kept = np.full(n, np.inf), [], []
    for weight, a, b in tree.tolist():
        a, b = int(a), int(b)
        ra, rb = root[a], root[b]
        small, big = (ra, rb) if len(members[ra]) < len(members[rb]) else (rb, ra)
        if len(members[small]) >= min_cluster_size:
            splits.append((weight, a, b))
        else:
            kept.append((a, b))
            if len(members[small]) + len(members[big]) >= min_cluster_size:
                for side in (small, big):
                    if len(members[side]) < min_cluster_size:
                        entered[members[side]] = weight
        for i in members[small]:
            root[i] = big
        members[big] += members[small]
        members[small] = []
    leaf = forest_labels(n, np.array(kept).reshape(-1, 2))
    edges = [(w, leaf[a], leaf[b]) for w, a, b in splits]
    chosen = select_clusters(int(leaf.max()) + 1, edges, lambda tree_: tree_.point_sums(leaf, entered))
    return chosen.labels(leaf, entered)


ALGORITHMS = {
    "kmeans": lambda x, k, seed, square=None: kmeans_labels(x, k, seed),
    "hierarchical": lambda x, k, seed, square=None: ward_labels(x, k, square),
    "spectral": lambda x, k, seed, square=None: spectral_labels(x, k, seed, square=square),
    "hdbscan": lambda x, k, seed, square=None: hdbscan_labels(x, square=square),
}


def cluster_groups(df: DataFrame, algorithms: Sequence[str] = tuple(ALGORITHMS),
                   n_clusters: int | str = "n_classes", by: Sequence[str] = ("bag_id",),
                   features: str = "features", label: str = "label", standardize: bool = True,
                   seed: int = 42) -> DataFrame:
    """Cluster every ``by`` group: the columns of ``df`` plus one column per algorithm.

    ``n_clusters`` is a number, ``'n_classes'`` (distinct labels of the group) or the name
    of a column.  Features come back standardised within the group.  Groups beyond
    :data:`MAX_GROUP_ROWS` are clustered one by one as whole tables; there can be few of them.
    k-means takes the same starts and steps on both sides of that limit; Ward and the
    density-based clustering are exact on both, spectral labels agree where the eigenvalues part.
    """
    by, algorithms = list(by), list(algorithms)
    unknown = [a for a in algorithms if a not in ALGORITHMS]
    if unknown:
        raise KeyError(f"unknown clusterings: {unknown}")
    if isinstance(n_clusters, str) and n_clusters not in ("n_classes", *df.columns):
        raise TypeError("n_clusters must be a number, 'n_classes' or a column")
    if n_clusters == "n_classes" and label not in df.columns:
        raise ValueError("the number of classes is unknown without a label")
    n_groups, largest = group_extent(df, by)
    large = None
    if largest > MAX_GROUP_ROWS:
        large = materialize(group_sizes(df, by).where(F.col("_n") > MAX_GROUP_ROWS))
    schema = T.StructType([*df.schema.fields, *[T.StructField(a, T.IntegerType()) for a in algorithms]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        x = np.stack(pdf[features].to_numpy()).astype(float)
        if standardize:
            x = z_scores(x)
            pdf[features] = list(x)
        if n_clusters == "n_classes":
            k = int(pdf[label].nunique())
        else:
            k = int(pdf[n_clusters].iloc[0]) if isinstance(n_clusters, str) else int(n_clusters)
        # The clusterings of a group share its distances.
        square = distances(x, x, squared=True) if set(algorithms) - {"kmeans"} else None
        return pdf.assign(**{a: ALGORITHMS[a](x, k, seed, square) for a in algorithms})

    if large is None:
        return spread(df, by, n_groups).groupBy(*by).applyInPandas(run, schema)
    small = match_groups(df, large.drop("_n"), by, "left_anti")
    result = spread(small, by, n_groups).groupBy(*by).applyInPandas(run, schema)
    for key in large.drop("_n").toLocalIterator():
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(key[c])) for c in by])
        whole = _as_table(df.where(same), algorithms, n_clusters, features, label, standardize, seed)
        result = result.unionByName(whole.select(*df.columns, *algorithms))
    return result


def _as_table(rows: DataFrame, algorithms: Sequence[str], n_clusters: int | str, features: str, label: str,
              standardize: bool, seed: int) -> DataFrame:
    """One large group by the whole-table clusterings."""
    from tablegauge.operators.clustering.whole import cluster_table
    from tablegauge.operators.ranking import number_rows

    if isinstance(n_clusters, str):
        wanted = F.count_distinct(label) if n_clusters == "n_classes" else F.max(n_clusters)
        n_clusters = int(rows.agg(wanted).first()[0])
    numbered = rows if "row_id" in rows.columns else number_rows(rows)
    own = numbered.select("row_id", F.col(features).alias("features"))
    found = cluster_table(own, n_clusters, algorithms, standardize=standardize, seed=seed)
    found = found.select("row_id", F.col("features").alias("_features"), *[F.col(a).alias(f"_{a}") for a in algorithms])
    joined = numbered.join(found, "row_id")
    return joined.select(*[F.col("_features").alias(c) if c == features else F.col(c) for c in rows.columns],
                         *[F.col(f"_{a}").alias(a) for a in algorithms])


def long_clusters(df: DataFrame, algorithms: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per algorithm: ``columns``, ``algorithm`` and ``cluster``; a projection, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.col(a).alias("cluster")) for a in algorithms])
    return df.select(*columns, F.inline(pairs))
