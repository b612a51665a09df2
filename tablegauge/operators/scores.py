"""Imbalance-weighted F1 of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (F1 of the majority + R * F1 of the minority) / (1 + R), R the size ratio of the true
#: classes; null unless both classes are among the true labels.
FORMULAS = {
    "f1_majority": "coalesce(try_divide(2 * hit_big, pred_big + n_big), 0D)",
    "f1_minority": "coalesce(try_divide(2 * hit_small, pred_small + n_small), 0D)",
    "imbalance_ratio": "try_divide(n_big, n_small)",
    "weighted_f1": "(f1_majority + imbalance_ratio * f1_minority) / (1 + imbalance_ratio)",
}


def prediction_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                      by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, prediction, n)``: the confusion table."""
    return df.groupBy(*by, F.col(label).cast("double").alias("label"),
                      F.col(prediction).cast("double").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction",
                by: Sequence[str] = ()) -> DataFrame:
    """Per group: majority and minority F1, their ratio and the weighted F1.

    On a tie the smaller label is the majority.  At most a few rows per group pass the
    first aggregation.
    """
    return f1_of_counts(prediction_counts(df, label, prediction, by), by)


def f1_of_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`weighted_f1` from confusion counts ``(by..., label, prediction, n)``."""
    by = list(by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    # Every cell counts for its true class and for its predicted one.
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("n_true"), hit.alias("hit"), zero.alias("n_pred")),
        F.struct(F.col("prediction").alias("c"), zero.alias("n_true"), zero.alias("hit"), F.col("n").alias("n_pred")))
    per_class = (cells.select(*by, F.inline(sides)).groupBy(*by, "c")
                 .agg(*[F.sum(x).cast("double").alias(x) for x in ("n_true", "hit", "n_pred")])
                 .where("n_true > 0"))
    item = F.struct((-F.col("n_true")).alias("neg"), "c", "n_true", "hit", "n_pred")
    ends = per_class.groupBy(*by).agg(F.min(item).alias("big"), F.max(item).alias("small"),
                                      F.count(F.lit(1)).alias("classes_"))
    values = ends.where("classes_ = 2").select(
        *by, F.col("big.n_true").alias("n_big"), F.col("big.hit").alias("hit_big"),
        F.col("big.n_pred").alias("pred_big"), F.col("small.n_true").alias("n_small"),
        F.col("small.hit").alias("hit_small"), F.col("small.n_pred").alias("pred_small"))
    for name, text in FORMULAS.items():
        values = values.withColumn(name, F.expr(text))
    return values.select(*by, *FORMULAS)


class WeightedF1Evaluator(Evaluator):
    """:func:`weighted_f1` for cross-validation; 0 where a class is missing."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        row = weighted_f1(dataset, self.label, self.prediction).first()
        return float(row["weighted_f1"]) if row else 0.0

    def isLargerBetter(self) -> bool:
        return True
