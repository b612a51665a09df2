"""The feature vector of a bag: indices of four clusterings in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.clustering.groups import ALGORITHMS, cluster_groups, long_clusters
from tablegauge.operators.external import external_indices
from tablegauge.operators.internal import internal_indices
from tablegauge.operators.pairs import PAIR_INDICES, pair_indices
from tablegauge.session import materialize

# The indices that enter the vector, in its order.
INTERNAL_NAMES = {
    "kmeans": ("Silhouette", "C", "Dunn", "Score"),
    "hierarchical": ("Silhouette", "C", "Dunn", "Score"),
    "spectral": ("Silhouette", "C", "Dunn", "Davies-Bouldin", "Ray-Turi", "Score"),
    "hdbscan": ("Log-SS-Ratio", "Silhouette", "Dunn", "Score"),
}
EXTERNAL_NAMES = (
    "Entropy", "Purity", "Precision", "Recall", "F", "Weighted-F", "Folkes-Mallows", "Rand",
    "Adjusted-Rand", "Adjusted-Mutual-Info", "Normalized-Mutual-Info", "Homogeneity",
    "Completeness", "V-Measure", "Jaccard", "Hubert Γ̂", "Kulczynski", "Phi", "Russel-Rao",
    "Rogers-Tanimoto", "Sokal-Sneath1", "Sokal-Sneath2")

#: (algorithm, index_type, index_name) of the 106 features, in order.
FEATURE_ORDER = [(algorithm, kind, name) for algorithm in INTERNAL_NAMES
                 for kind, names in (("internal_indices", INTERNAL_NAMES[algorithm]),
                                     ("external_indices", EXTERNAL_NAMES))
                 for name in names]


def feature_name(algorithm: str, kind: str, name: str) -> str:
    """Column name of a feature, safe for SQL and ML stages."""
    plain = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in name).strip("_").lower()
    return f"{algorithm}_{kind.split('_')[0]}_{plain}"


FEATURE_NAMES = [feature_name(*triple) for triple in FEATURE_ORDER]


def cluster_indices(df: DataFrame, algorithms: Sequence[str] = tuple(ALGORITHMS),
                    by: Sequence[str] = ("bag_id",), label: str = "label", features: str = "features",
                    row_id: str = "row_id", noise: object = -1) -> DataFrame:
    """Long table ``(by..., algorithm, index_type, index_name, value)`` of clustered rows.

    ``df`` has one cluster column per algorithm, as
    :func:`~tablegauge.operators.clustering.cluster_groups` returns them.  The contingency
    tables need no features, the pair indices share one set of distances, and the moments
    are combined before their shuffle.
    """
    by, algorithms = list(by), list(algorithms)
    keys = [*by, "algorithm"]
    external = external_indices(long_clusters(df, algorithms, [*by, label]), label, "cluster",
                                EXTERNAL_NAMES, keys, noise)
    names = list(dict.fromkeys(n for a in algorithms for n in INTERNAL_NAMES[a]))
    pairs = pair_indices(df, features, algorithms, by, row_id).unpivot(
        keys, [n for n in PAIR_INDICES if n in names], "index_name", "value")
    rest = [n for n in names if n not in PAIR_INDICES]
    internal = pairs.unionByName(internal_indices(
        long_clusters(df, algorithms, [*by, row_id, features]), features, "cluster", rest, keys, row_id))
    chosen = F.lit(False)
    for algorithm in algorithms:
        chosen = chosen | ((F.col("algorithm") == algorithm) & F.col("index_name").isin(list(INTERNAL_NAMES[algorithm])))
    columns = [*keys, "index_type", "index_name", "value"]
    return (internal.where(chosen).withColumn("index_type", F.lit("internal_indices")).select(*columns)
            .unionByName(external.withColumn("index_type", F.lit("external_indices")).select(*columns)))


def generate_indices(bags: DataFrame, algorithms: Sequence[str] = tuple(ALGORITHMS),
                     by: Sequence[str] = ("bag_id",), label: str = "label",
                     features: str = "features", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Cluster every bag with the named algorithms and compute their indices (long table).

    The clustered rows are written once: whole bags per file, so later groupings by bag
    combine almost everything before they shuffle.
    """
    kept = bags.select(*by, row_id, features, label)
    clustered = materialize(cluster_groups(kept, algorithms, "n_classes", by, features, label, seed=seed))
    return cluster_indices(clustered, algorithms, by, label, features, row_id)


def pivot_features(indices: DataFrame, by: Sequence[str] = ("bag_id",)) -> DataFrame:
    """Long index table -> one row per bag with the 106 features in order.

    The pivot values are given, so no extra pass looks for them.
    """
    key = F.concat_ws("|", "algorithm", "index_type", "index_name")
    values = ["|".join(triple) for triple in FEATURE_ORDER]
    wide = (indices.select(*by, key.alias("_key"), "value").groupBy(*by)
            .pivot("_key", values).agg(F.first("value", ignorenulls=True)))
    return wide.toDF(*by, *FEATURE_NAMES)


def metafeatures(bags: DataFrame, by: Sequence[str] = ("bag_id",), label: str = "label",
                 features: str = "features", row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Bags ``(by..., row_id, features, label)`` -> the feature vectors."""
    return pivot_features(generate_indices(bags, by=by, label=label, features=features,
                                           row_id=row_id, seed=seed), by)
