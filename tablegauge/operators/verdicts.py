"""From bags to the table: votes, means and the consolidated report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The classifier families, in report order.
MODELS = ("decision tree", "random forest", "logistic regression", "k-nearest neighbor",
          "xgboost", "support vector machine")


def vote_hardness(bags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``is_hard`` of the table: at least half of its bags are hard."""
    share = F.avg(F.col("is_hard").cast("int"))
    return bags.groupBy(*by).agg((share >= 0.5).alias("is_hard"))


def mean_scores(scores: DataFrame, by: Sequence[str] = (), value: str = "est_f1") -> DataFrame:
    """``(by..., model, value)``: mean over the bags per model."""
    return scores.groupBy(*by, "model").agg(F.avg(value).alias(value))


def consolidated_report(indices: DataFrame, hardness: DataFrame, scores: DataFrame,
                        columns: Sequence[str] | None = None, models: Sequence[str] = MODELS) -> DataFrame:
    """Bags x (indices, hardness, scores), and a last row ``Dataset`` with vote and means.

    ``indices`` is the long index table; ``columns`` lists its ``algorithm.type.name``
    keys to keep them from being looked up.
    """
    long = indices.select("bag_id", F.concat_ws(".", "algorithm", "index_type", "index_name").alias("_c"), "value")
    pivot = long.groupBy("bag_id").pivot("_c", list(columns) if columns else None)
    wide = pivot.agg(F.first("value", ignorenulls=True))
    est = scores.groupBy("bag_id").pivot("model", list(models)).agg(F.first("est_f1"))
    bags = (wide.join(hardness.select("bag_id", F.col("is_hard")), "bag_id")
            .join(est, "bag_id").withColumn("bag", F.concat(F.lit("Bag "), F.col("bag_id"))))
    means = scores.groupBy().pivot("model", list(models)).agg(F.avg("est_f1"))
    dataset = (means.withColumn("bag", F.lit("Dataset")))
    vote = vote_hardness(hardness).withColumn("bag", F.lit("Dataset"))
    return bags.drop("bag_id").unionByName(dataset.join(vote, "bag"), allowMissingColumns=True)


def flat_report_columns() -> list[str]:
    from tablegauge.operators.metafeatures import FEATURE_ORDER
    return [".".join(t) for t in FEATURE_ORDER]
