"""Class counts, roles and weights of a label column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, count)`` of every label value."""
    return df.groupBy(F.col(label).alias("label")).count()


def check_binary(df: DataFrame, label: str = "label") -> DataFrame:
    """Return ``df`` if ``label`` has exactly two classes, else raise ``ValueError``."""
    seen = df.where(F.col(label).isNotNull()).select(label).distinct().limit(3).count()
    if seen != 2:
        raise ValueError("the table is not a binary classification table: "
                         + ("more than two" if seen > 2 else str(seen)) + " classes")
    return df


def class_roles(df: DataFrame, label: str = "label") -> DataFrame:
    """One row ``(majority, minority, n_majority, n_minority, imbalance_ratio)``.

    On a tie the smaller label is the majority.
    """
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    by_size = F.struct((-F.col("count")).alias("neg"), F.col("label").alias("label"))
    ends = counts.agg(F.min(by_size).alias("big"), F.max(by_size).alias("small"),
                      F.count(F.lit(1)).alias("n_classes"))
    return ends.where("n_classes = 2").select(
        F.col("big.label").alias("majority"),
        F.col("small.label").alias("minority"),
        (-F.col("big.neg")).alias("n_majority"),
        (-F.col("small.neg")).alias("n_minority"),
        (F.col("big.neg") / F.col("small.neg")).alias("imbalance_ratio"))


def imbalance_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """One row with the majority / minority size ratio."""
    return class_roles(df, label).select("imbalance_ratio")


def balanced_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """Add a weight column: the imbalance ratio for the minority class, 1 for the majority."""
    roles = class_roles(df, label).select("minority", "imbalance_ratio")
    return (df.join(F.broadcast(roles), df[label] == roles["minority"], "left")
            .withColumn(weight, F.coalesce("imbalance_ratio", F.lit(1.0)))
            .drop("minority", "imbalance_ratio"))
