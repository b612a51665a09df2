"""Class x cluster counts and everything that follows from them in one small pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = "decimal(38,0)"


def contingency(df: DataFrame, class_col: str, cluster_col: str,
                by: Sequence[str] = ()) -> DataFrame:
    """``(by..., class, cluster, n)``: a hash aggregation that combines before the shuffle."""
    return (df.groupBy(*by, F.col(class_col).alias("class"), F.col(cluster_col).alias("cluster"))
            .agg(F.count(F.lit(1)).alias("n")))


def choose_two(n: Column) -> Column:
    """n(n-1)/2, exact for any BIGINT count."""
    wide = n.cast(PAIR)
    return (wide * (wide - 1) / 2).cast(PAIR)


def _n_log_n(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 0, n * F.ln(n)).otherwise(0.0)


def summarize(cells: DataFrame, by: Sequence[str] = (), noise: object = None) -> DataFrame:
    """One row per group with the sums that all agreement indices are made of.

    From cells n_ij with class margins a_i and cluster margins b_j: the pair sums
    C(n_ij,2), C(a_i,2), C(b_j,2), the sums of n ln n over cells and margins, the sum of
    each cluster's largest cell, and the same cluster terms without the ``noise`` cluster.
    """
    by = list(by)
    grouped = cells.groupingSets(
        [[*by, "class", "cluster"], [*by, "class"], [*by, "cluster"]], *by, "class", "cluster",
    ).agg(F.sum("n").alias("m"), F.max("n").alias("top"),
          F.grouping("class").alias("g_class"), F.grouping("cluster").alias("g_cluster"))
    is_cell = (F.col("g_class") == 0) & (F.col("g_cluster") == 0)
    is_class = (F.col("g_class") == 0) & (F.col("g_cluster") == 1)
    is_cluster = (F.col("g_class") == 1) & (F.col("g_cluster") == 0)
    m = F.col("m")
    kept = F.lit(True)
    if noise is not None:
        kept = ~F.col("cluster").cast("string").eqNullSafe(F.lit(str(noise)))

    def total(where: Column, value: Column, name: str) -> Column:
        return F.sum(F.when(where, value)).alias(name)

    return grouped.groupBy(*by).agg(
        total(is_class, m, "n"),
        F.count_if(is_class).alias("n_classes"),
        F.count_if(is_cluster).alias("n_clusters"),
        total(is_cell, choose_two(m), "pairs_both"),
        total(is_class, choose_two(m), "pairs_class"),
        total(is_cluster, choose_two(m), "pairs_cluster"),
        total(is_cell, _n_log_n(m), "log_cells"),
        total(is_class, _n_log_n(m), "log_classes"),
        total(is_cluster, _n_log_n(m), "log_clusters"),
        F.coalesce(total(is_cell & kept, _n_log_n(m), ""), F.lit(0.0)).alias("log_cells_kept"),
        F.coalesce(total(is_cluster & kept, _n_log_n(m), ""), F.lit(0.0)).alias("log_clusters_kept"),
        total(is_cluster, F.col("top"), "top_sum"))


def pair_confusion(summary: DataFrame) -> DataFrame:
    """Add TP, FN, FP, TN over all row pairs, from the pair sums (no pair is formed)."""
    all_pairs = choose_two(F.col("n"))
    return summary.withColumns({
        "TP": F.col("pairs_both"),
        "FN": (F.col("pairs_class") - F.col("pairs_both")).cast(PAIR),
        "FP": (F.col("pairs_cluster") - F.col("pairs_both")).cast(PAIR),
        "TN": (all_pairs - F.col("pairs_class") - F.col("pairs_cluster") + F.col("pairs_both")).cast(PAIR),
    })


def cluster_entropies(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, size, entropy)``: class entropy (bits) inside every cluster."""
    sums = cells.groupBy(*by, "cluster").agg(
        F.sum("n").alias("size"), F.sum(_n_log_n(F.col("n"))).alias("log_cells"))
    nats = F.ln(F.col("size").cast("double")) - F.col("log_cells") / F.col("size")
    return sums.select(*by, "cluster", "size", (nats / F.ln(F.lit(2.0))).alias("entropy"))


def cluster_modes(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., cluster, mode, n)``: the most frequent class per cluster, smaller class on ties."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("class").alias("class"))).alias("best")
    return (cells.groupBy(*by, "cluster").agg(best)
            .select(*by, "cluster", F.col("best.class").alias("mode"), (-F.col("best.neg")).alias("n")))
