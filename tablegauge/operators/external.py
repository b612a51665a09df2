"""Agreement of a clustering with the classes: 23 indices from the contingency table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.numbers import log_gamma
from tablegauge.operators.contingency import contingency, pair_confusion, summarize
from tablegauge.session import fold, match_groups

#: Entropies below this are rounding noise around zero.
ZERO_ENTROPY = 1e-12

#: Building blocks of the formulas, over the summary of :func:`pair_confusion`.
TERMS = {
    "pairs": "TP + FN + FP + TN",
    "mi": "greatest(0D, (log_cells - log_classes - log_clusters) / n + ln(n))",
    "h_class": "greatest(0D, ln(n) - log_classes / n)",
    "h_cluster": "greatest(0D, ln(n) - log_clusters / n)",
}
#: Terms made of terms.
SHARES = {
    "precision": "try_divide(TP, TP + FP)",
    "recall": "try_divide(TP, TP + FN)",
    "chance": "try_divide(pairs_class * pairs_cluster, pairs)",
    "homogeneity": f"CASE WHEN h_class < {ZERO_ENTROPY} THEN 1D ELSE mi / h_class END",
    "completeness": f"CASE WHEN h_cluster < {ZERO_ENTROPY} THEN 1D ELSE mi / h_cluster END",
    "h_mean": "(h_class + h_cluster) / 2",
}

#: Index name -> formula.  A zero denominator gives null.
EXTERNAL_INDICES = {
    "Entropy": "greatest(0D, (log_clusters_kept - log_cells_kept) / n / ln(2D))",
    "Purity": "top_sum / n",
    "Precision": "precision",
    "Recall": "recall",
    "F": "try_divide(2 * TP, 2 * TP + FN + FP)",
    "Weighted-F": "try_divide(2 * TP, 2 * TP + FN + FP)",
    "Folkes-Mallows": "try_divide(TP, sqrt(TP + FP) * sqrt(TP + FN))",
    "Rand": "try_divide(TP + TN, pairs)",
    "Adjusted-Rand": "CASE WHEN FN = 0 AND FP = 0 THEN 1D ELSE "
                     "try_divide(TP - chance, (pairs_class + pairs_cluster) / 2 - chance) END",
    "Adjusted-Mutual-Info": f"CASE WHEN h_mean < {ZERO_ENTROPY} THEN 1D ELSE "
                            "try_divide(mi - expected_mi, h_mean - expected_mi) END",
    "Normalized-Mutual-Info": f"CASE WHEN h_mean < {ZERO_ENTROPY} THEN 1D ELSE mi / h_mean END",
    "Homogeneity": "homogeneity",
    "Completeness": "completeness",
    "V-Measure": "CASE WHEN homogeneity + completeness = 0 THEN 0D ELSE "
                 "2 * homogeneity * completeness / (homogeneity + completeness) END",
    "Jaccard": "try_divide(TP, TP + FN + FP)",
    "Hubert Γ̂": "try_divide(pairs * TP - pairs_cluster * pairs_class, sqrt(pairs_cluster) * sqrt(pairs_class)"
                 " * sqrt(pairs - pairs_cluster) * sqrt(pairs - pairs_class))",
    "Kulczynski": "0.5D * (precision + recall)",
    "McNemar": "try_divide(TN - FP, sqrt(TN + FP))",
    "Phi": "try_divide(TP * TN - FN * FP, (TP + FN) * (TP + FP) * (FN + TN) * (FP + TN))",
    "Russel-Rao": "try_divide(TP, pairs)",
    "Rogers-Tanimoto": "try_divide(TP + TN, TP + TN + 2 * (FN + FP))",
    "Sokal-Sneath1": "try_divide(TP, TP + 2 * (FN + FP))",
    "Sokal-Sneath2": "try_divide(TP + TN, TP + TN + 0.5D * (FN + FP))",
}
#: Entropy with the noise cluster counted as any other.
ENTROPY_OF_PARTITION = "greatest(0D, (log_clusters - log_cells) / n / ln(2D))"


#: Margins of one side that one task pairs with the other side.
MARGIN_SLICE = 64


def expected_mutual_info(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., expected_mi)`` under random labelings with the same margins.

    Equal margins are counted once with a multiplicity.  For margins a, b the cell size k
    is hypergeometric; terms more than 12 deviations + 60 from its mean weigh less than
    1e-30 and are not formed, and the weights are normalised, which cancels the rounding
    of the large log-gamma values.
    """
    by = list(by)

    def margins(column: str) -> DataFrame:
        sizes = cells.groupBy(*by, column).agg(F.sum("n").alias("m"))
        return sizes.groupBy(*by, "m").agg(F.count(F.lit(1)).alias("times"))

    def listed(column: str, out: str) -> DataFrame:
        # Distinct margins only: at most sqrt(2n) per group, a handful in practice.
        pairs = F.collect_list(F.struct(F.col("m"), F.col("times")))
        return margins(column).groupBy(*by).agg(pairs.alias(out), F.sum(F.col("m") * F.col("times")).alias(f"n_{out}"))

    sides = (listed("class", "a").withColumnRenamed("n_a", "n").withColumn("b", F.lit(None).cast(
        "array<struct<m:bigint,times:bigint>>")).unionByName(
        listed("cluster", "b").withColumnRenamed("n_b", "n").withColumn("a", F.lit(None).cast(
            "array<struct<m:bigint,times:bigint>>"))))
    joined = sides.groupBy(*by).agg(F.max("n").alias("n"), F.first("a", True).alias("a"), F.first("b", True).alias("b"))
    # Pairs are dealt out before they are formed: slices of the one side, each with the other side.
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / MARGIN_SLICE).cast("int")),
                         lambda i: F.struct(i.alias("slice"), F.slice("a", i * MARGIN_SLICE + 1, MARGIN_SLICE).alias("a")))
    spark = cells.sparkSession
    n_tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = joined.select(*by, "n", F.inline(slices), "b").repartition(n_tasks, *by, "slice")
    pairs = (dealt.select(*by, "n", F.explode("a").alias("a"), "b")
             .select(*by, "n", "a", F.explode("b").alias("b"))
             .select(*by, F.col("n").cast("double").alias("n"),
                     F.col("a.m").cast("double").alias("a"), F.col("b.m").cast("double").alias("b"),
                     (F.col("a.times") * F.col("b.times")).cast("double").alias("times")))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    mean = a * b / n
    deviation = F.sqrt(mean * (n - a) / n * (n - b) / F.greatest(n - 1, F.lit(1.0)))
    reach = F.lit(12.0) * deviation + 60
    low = F.greatest(F.lit(0.0), a + b - n, F.floor(mean - reach).cast("double"))
    high = F.least(a, b, F.ceil(mean + reach).cast("double"))
    # What does not depend on k is worked out once per pair of margins, before its terms are formed.
    alone = {"fixed": log_gamma(a + 1) + log_gamma(b + 1) + log_gamma(n - a + 1) + log_gamma(n - b + 1) - log_gamma(n + 1),
             "ln_n": F.ln(n), "ln_a": F.ln(a), "ln_b": F.ln(b)}
    terms = pairs.withColumns(alone).withColumn("k", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    k = F.col("k").cast("double")
    log_weight = (F.col("fixed") - log_gamma(k + 1) - log_gamma(a - k + 1)
                  - log_gamma(b - k + 1) - log_gamma(n - a - b + k + 1))
    info = F.when(k > 0, k / n * (F.col("ln_n") + F.ln(k) - F.col("ln_a") - F.col("ln_b"))).otherwise(0.0)
    weighted = terms.withColumn("w", F.exp(log_weight))
    per_pair = weighted.groupBy(*by, "n", "a", "b", "times").agg(
        F.sum(F.col("w") * info).alias("s"), F.sum("w").alias("total"))
    return per_pair.groupBy(*by).agg(F.sum(F.col("times") * F.col("s") / F.col("total")).alias("expected_mi"))


def agreement_summary(df: DataFrame, class_col: str, cluster_col: str, by: Sequence[str] = (),
                      names: Sequence[str] | None = None, noise: object = -1) -> DataFrame:
    """Per group: pair counts, margins sums and, if needed, the expected mutual information."""
    by = list(by)
    cells = contingency(df, class_col, cluster_col, by)
    summary = pair_confusion(summarize(cells, by, noise))
    if names is not None and "Adjusted-Mutual-Info" not in names:
        return summary
    expected = expected_mutual_info(cells, by)
    if by:
        return match_groups(summary, expected, by)
    return fold([summary, expected])


def external_indices(df: DataFrame, class_col: str = "label", cluster_col: str = "cluster",
                     names: Sequence[str] | None = None, by: Sequence[str] = (),
                     noise: object = -1) -> DataFrame:
    """Long table ``(by..., index_name, value)`` of the named indices (default: all).

    ``noise`` names the cluster whose rows stay in n but leave the entropy sum; ``None``
    treats it as any other cluster.  A zero denominator gives null.
    """
    names = list(names or EXTERNAL_INDICES)
    unknown = [x for x in names if x not in EXTERNAL_INDICES]
    if unknown:
        raise KeyError(f"unknown external indices: {unknown}")
    formulas = {x: EXTERNAL_INDICES[x] for x in names}
    if noise is None and "Entropy" in formulas:
        formulas["Entropy"] = ENTROPY_OF_PARTITION
    wide = evaluate(agreement_summary(df, class_col, cluster_col, by, names, noise), formulas, by)
    return wide.unpivot(list(by), names, "index_name", "value")


def evaluate(summary: DataFrame, formulas: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., one DOUBLE column per formula)``."""
    counts = [c for c in summary.columns if c not in by]
    doubles = summary.select(*by, *[F.col(c).cast("double").alias(c) for c in counts])
    for terms in (TERMS, SHARES):
        doubles = doubles.withColumns({name: F.expr(text) for name, text in terms.items()})
    return doubles.select(*by, *[F.expr(text).alias(name) for name, text in formulas.items()])


def weighted_f(df: DataFrame, class_col: str, cluster_col: str, beta: float,
               by: Sequence[str] = ()) -> DataFrame:
    """The F-measure that gives recall ``beta`` times the weight of precision."""
    summary = agreement_summary(df, class_col, cluster_col, by, names=[])
    b2 = float(beta * beta)
    formula = f"try_divide((1 + {b2}D) * TP, (1 + {b2}D) * TP + {b2}D * FN + FP)"
    return evaluate(summary, {"value": formula}, by)
