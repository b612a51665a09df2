"""Clusterings: of a whole table as Spark jobs, or of every small group in its own task."""

from tablegauge.operators.clustering.fixed import assign_nearest
from tablegauge.operators.clustering.groups import ALGORITHMS, cluster_groups, long_clusters
from tablegauge.operators.clustering.kmeans import kmeans

__all__ = ["ALGORITHMS", "assign_nearest", "cluster_groups", "kmeans", "long_clusters"]
