"""Sizes, centroids, scatter and distances to centroids per cluster."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.vectors import as_vector, euclidean_distance
from tablegauge.operators.blocks import attach_params
from tablegauge.session import broadcast_if_small, match_groups

#: Group accumulators one task keeps before it emits them.
MAX_ACCUMULATORS = 256
#: Up to this many features, products are summed as expressions (136 sums at most).
EXPRESSION_WIDTH = 15


def cluster_moments(df: DataFrame, features: str = "features", cluster: str = "cluster",
                    by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, size, centroid, wgss)`` in one pass by the built-in vector aggregate.

    ``wgss`` is the sum of squared distances to the centroid.
    """
    stats = df.groupBy(*by, F.col(cluster).alias("cluster")).agg(
        Summarizer.metrics("count", "mean", "variance").summary(as_vector(features)).alias("s"))
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda acc, v: acc + v)
    return stats.select(*by, "cluster", F.col("s.count").alias("size"),
                        vector_to_array("s.mean").alias("centroid"),
                        (spread * (F.col("s.count") - 1)).alias("wgss"))


def global_means(df: DataFrame, by: Sequence[str] = (), features: str = "features") -> DataFrame:
    """``(by..., global_mean)``."""
    return df.groupBy(*by).agg(
        vector_to_array(Summarizer.mean(as_vector(features))).alias("global_mean"))


def to_mean(df: DataFrame, means: DataFrame, by: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Add ``global_mean`` and the row's distance ``to_mean``."""
    return attach_params(df, means, by).withColumn(
        "to_mean", euclidean_distance(features, "global_mean"))


def moment_sums(moments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group, from its cluster rows: n, K, WGSS, BGSS and the per-cluster sums."""
    share = F.col("wgss") / F.col("size")
    folded = moments.groupBy(*by).agg(
        F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum("wgss").alias("wgss"), F.sum(share).alias("mean_dispersions"),
        F.sum(F.when(F.col("wgss") != 0, F.col("size") * F.ln(share))).alias("log_dispersions"),
        F.sum(F.col("size").cast("double") * F.col("size")).alias("size_squares"),
        Summarizer.metrics("variance").summary(as_vector("centroid"), F.col("size").cast("double")).alias("s"))
    # The weighted variance of the centroids, times its denominator, is the scatter between clusters.
    between = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda acc, v: acc + v)
    return folded.withColumn("bgss", between * (F.col("n") - F.col("size_squares") / F.col("n"))).drop("s")


def row_distances(df: DataFrame, moments: DataFrame, means: DataFrame, features: str = "features",
                  cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Add each row's distance to its own centroid and to the global mean.

    ``moments`` should be materialized; it is broadcast if it is small.
    """
    by = list(by)
    width = len(moments.select("centroid").first()[0]) if not moments.isEmpty() else 1
    centroids = broadcast_if_small(moments.select(
        *[F.col(k).alias(f"_{k}") for k in by], F.col("cluster").alias("_cluster"), "centroid"), width)
    condition = df[cluster].eqNullSafe(centroids["_cluster"])
    for k in by:
        condition = condition & df[k].eqNullSafe(centroids[f"_{k}"])
    joined = df.join(centroids, condition).drop("_cluster", *[f"_{k}" for k in by])
    return (to_mean(joined, means, by, features)
            .withColumn("to_centroid", euclidean_distance(features, "centroid"))
            .drop("centroid", "global_mean"))


def cluster_dispersion(df: DataFrame, moments: DataFrame, means: DataFrame, features: str = "features",
                       cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """``moments`` with ``mean_to_centroid``, ``sum_to_centroid``, ``sum_to_mean`` and the
    centroid's distance to the global mean (``centroid_to_mean``)."""
    by = list(by)
    sums = (row_distances(df, moments, means, features, cluster, by)
            .groupBy(*by, F.col(cluster).alias("_c"))
            .agg(F.sum("to_centroid").alias("sum_to_centroid"), F.sum("to_mean").alias("sum_to_mean"),
                 F.avg("to_centroid").alias("mean_to_centroid")))
    condition = moments["cluster"].eqNullSafe(sums["_c"])
    renamed = sums.withColumnsRenamed({k: f"_{k}" for k in by})
    for k in by:
        condition = condition & moments[k].eqNullSafe(renamed[f"_{k}"])
    joined = moments.join(renamed, condition).drop("_c", *[f"_{k}" for k in by])
    return attach_params(joined, means, by).withColumn(
        "centroid_to_mean", euclidean_distance("centroid", "global_mean")).drop("global_mean")


def _narrow_scatter(rows: DataFrame, by: list[str], width: int) -> DataFrame:
    """:func:`scatter_rows` of a few features as plain sums: one hash aggregation, no Python."""
    x = [F.col("features")[i] - F.col("global_mean")[i] for i in range(width)]
    names = {(i, j): f"s_{i}_{j}" for i in range(width) for j in range(i, width)}
    sums = rows.groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.sum(x[i]).alias(f"t_{i}") for i in range(width)],
        *[F.sum(x[i] * x[j]).alias(name) for (i, j), name in names.items()])
    lines = [F.struct(F.lit(-1).alias("i"), F.array(*[F.col(f"t_{i}") for i in range(width)]).alias("row"))]
    for i in range(width):
        cells = [F.col(names[min(i, j), max(i, j)]) for j in range(width)]
        lines.append(F.struct(F.lit(i).alias("i"), F.array(*cells).alias("row")))
    return sums.select(*by, "cluster", "size", F.inline(F.array(*lines))).select(*by, "cluster", "i", "size", "row")


def scatter_rows(df: DataFrame, means: DataFrame, features: str = "features",
                 cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, i, size, row)``: sums over the rows of each cluster, centred on the
    global mean.  ``i >= 0``: row i of X'X; ``i = -1``: the sum of X.

    Few features are summed as expressions.  For more, every task adds up its own rows as
    matrices first, so the shuffle carries d + 1 short rows per task, group and cluster.
    """
    by = list(by)
    rows = attach_params(df.select(*by, F.col(cluster).cast("string").alias("cluster"),
                                   F.col(features).alias("features")), means, by)
    first = rows.select(F.size("features")).first()
    if first and first[0] <= EXPRESSION_WIDTH:
        return _narrow_scatter(rows, by, first[0])
    schema = T.StructType([rows.schema[k] for k in by] + T.StructType.fromDDL(
        "cluster string, i int, size bigint, row array<double>").fields)
    names = [f.name for f in schema.fields]

    def emit(sums: dict) -> pd.DataFrame:
        out = []
        for key, (n, total, square) in sums.items():
            for i in range(-1, len(total)):
                out.append((*key, i, n, total if i < 0 else square[i]))
        return pd.DataFrame(out, columns=names)

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for key, part in batch.groupby([*by, "cluster"], dropna=False, sort=False):
                x = np.stack(part["features"].to_numpy()) - np.stack(part["global_mean"].to_numpy())
                n, total, square = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(x), total + x.sum(0), square + x.T @ x)
            if len(sums) > MAX_ACCUMULATORS:
                yield emit(sums)
                sums = {}
        if sums:
            yield emit(sums)

    return (rows.mapInPandas(partial, schema).groupBy(*by, "cluster", "i")
            .agg(F.sum("size").alias("size"),
                 vector_to_array(Summarizer.sum(as_vector("row"))).alias("row")))


def scatter_matrices(df: DataFrame, features: str = "features", cluster: str = "cluster",
                     by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, i, row)``: the rows of each cluster's within-scatter matrix."""
    by = list(by)
    sums = scatter_rows(df, global_means(df, by, features), features, cluster, by)
    totals = sums.where("i = -1").select(*by, "cluster", F.col("row").alias("total"), "size")
    joined = match_groups(sums.where("i >= 0").drop("size"), totals, [*by, "cluster"])
    # W = X'X - s s' / n, with s the sum of the centred rows.
    corrected = F.zip_with("row", "total", lambda v, t: v - F.get("total", F.col("i")) * t / F.col("size"))
    return joined.select(*by, "cluster", "i", corrected.alias("row"))


def matrix_stats(df: DataFrame, features: str = "features", cluster: str = "cluster",
                 by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, K, det T, det W, trace(W^-1 B) and the sum of n_k ln det(W_k / n_k).

    The input of the last step is K (d + 1) rows of d numbers per group.
    """
    by = list(by)
    sums = scatter_rows(df, global_means(df, by, features), features, cluster, by)
    schema = T.StructType([sums.schema[k] for k in by] + T.StructType.fromDDL(
        "n bigint, k bigint, det_t double, det_w double, trace_wib double, log_dets double").fields)

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = len(pdf["row"].iloc[0])
        total, within, n, log_dets = np.zeros((d, d)), np.zeros((d, d)), 0, 0.0
        for _, part in pdf.groupby("cluster", dropna=False):
            part = part.sort_values("i")
            s, square = part["row"].iloc[0], np.stack(part["row"].iloc[1:].to_numpy())
            size = int(part["size"].iloc[0])
            w = square - np.outer(s, s) / size
            total, within, n = total + square, within + w, n + size
            det = np.linalg.det(w / size)
            log_dets = log_dets + size * np.log(det) if det > 0 else np.nan
        det_w = np.linalg.det(within)
        trace = np.trace(np.linalg.solve(within, total - within)) if det_w > 0 else np.nan
        return pd.DataFrame([(*key, n, pdf["cluster"].nunique(dropna=False), np.linalg.det(total), det_w,
                              trace, log_dets)], columns=[f.name for f in schema.fields])

    return sums.groupBy(*by).applyInPandas(finish, schema)
