"""All clusterings of a whole table at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.clustering.groups import ALGORITHMS
from tablegauge.operators.clustering.hdbscan import hdbscan
from tablegauge.operators.clustering.kmeans import kmeans
from tablegauge.operators.clustering.spectral import spectral
from tablegauge.operators.clustering.ward import ward
from tablegauge.operators.scaling import standardize_array
from tablegauge.session import materialize


def cluster_table(df: DataFrame, n_clusters: int | str = "n_classes",
                  algorithms: Sequence[str] = tuple(ALGORITHMS), label: str = "label",
                  standardize: bool = True, seed: int = 42) -> DataFrame:
    """``df`` with standardised features and one cluster column per algorithm."""
    if isinstance(n_clusters, str) and n_clusters != "n_classes":
        raise TypeError("n_clusters must be a number or 'n_classes'")
    if n_clusters == "n_classes" and label not in df.columns:
        raise ValueError("the number of classes is unknown without a label")
    k = df.select(label).distinct().count() if n_clusters == "n_classes" else int(n_clusters)
    rows = materialize(standardize_array(df) if standardize else df)
    runs = {"kmeans": lambda: kmeans(rows, k, seed=seed), "hierarchical": lambda: ward(rows, k),
            "spectral": lambda: spectral(rows, k, seed=seed), "hdbscan": lambda: hdbscan(rows)}
    result = rows
    for a in algorithms:
        labels = materialize(runs[a]().select("row_id", F.col("cluster").cast("int").alias(a)))
        result = result.join(labels, "row_id")
    return result
