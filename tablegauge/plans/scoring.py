"""Hardness and expected F1 of bags from their feature vectors.

The published weights behind these scores are not available, so the models are trained
here on a table of tasks: one row per bag with the 106 features, the six true F1 scores of
its table, and whether the table is hard.  Predictions are therefore this library's own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.metafeatures import FEATURE_NAMES
from tablegauge.operators.verdicts import MODELS
from tablegauge.session import materialize

#: Fixed value: a table is hard if no family gets beyond this F1.
HARD_BELOW = 0.6


def model_column(model: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in model)


MODEL_COLUMNS = {m: model_column(m) for m in MODELS}


def check_features(df: DataFrame, expected: Sequence[str] = tuple(FEATURE_NAMES)) -> None:
    """The vectors must have the features the models were trained on, in their order."""
    found = [c for c in df.columns if c in set(expected)]
    if found != list(expected):
        raise ValueError("mismatch between the features of the table and those of the models")


def meta_table(features: DataFrame, true_scores: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Join the bags of every task with its true F1 scores and add ``easy`` (1 or 0)."""
    wide = (true_scores.groupBy(*by).pivot("model", list(MODELS)).agg(F.first("true_f1"))
            .withColumnsRenamed(MODEL_COLUMNS))
    best = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in MODEL_COLUMNS.values()])
    # One row per task.
    return features.join(F.broadcast(wide.withColumn("easy", (best > HARD_BELOW).cast("double"))), list(by))


@dataclass(frozen=True)
class MetaModels:
    """A fitted preparation, one regressor per family and the hardness classifier."""

    preparation: PipelineModel
    regressors: Mapping[str, object]
    classifier: object | None
    constant_easy: float | None = None
    features: tuple[str, ...] = tuple(FEATURE_NAMES)


def train_meta_models(table: DataFrame, trees: int = 50, depth: int = 8, seed: int = 42) -> MetaModels:
    """Fit the models on a :func:`meta_table`; missing feature values take the column mean.

    A feature or family without any value is left out.
    """
    check_features(table)
    seen = table.agg(*[F.count(c).alias(c) for c in [*FEATURE_NAMES, *MODEL_COLUMNS.values()]],
                     F.min("easy").alias("lo"), F.max("easy").alias("hi")).first()
    used = [c for c in FEATURE_NAMES if seen[c]]
    filled = [f"{c}_filled" for c in used]
    preparation = Pipeline(stages=[Imputer(inputCols=used, outputCols=filled),
                                   VectorAssembler(inputCols=filled, outputCol="_vector")]).fit(table)
    rows = materialize(preparation.transform(table).select(
        "_vector", "easy", *[F.col(c).alias(f"true_{c}") for c in MODEL_COLUMNS.values()]))
    options = {"featuresCol": "_vector", "numTrees": trees, "maxDepth": depth, "seed": seed}
    fits = {model: (RandomForestRegressor(labelCol=f"true_{column}", predictionCol=column, **options),
                    rows.where(F.col(f"true_{column}").isNotNull()))
            for model, column in MODEL_COLUMNS.items() if seen[column]}
    regressed = len(fits)
    if seen["lo"] != seen["hi"]:
        fits["easy"] = (RandomForestClassifier(labelCol="easy", predictionCol="_easy", probabilityCol="_p",
                                               rawPredictionCol="_r", **options), rows)
    # The fits share nothing and are chains of short jobs.
    with ThreadPool(max(1, len(fits))) as pool:
        fitted = pool.map(inheritable_thread_target(lambda fit: fit[0].fit(fit[1])), list(fits.values()), 1)
    regressors = dict(zip(list(fits)[:regressed], fitted))
    classifier = fitted[-1] if len(fits) > regressed else None
    return MetaModels(preparation, regressors, classifier, None if classifier else float(seen["lo"]))


def _prepared(features: DataFrame, models: MetaModels) -> DataFrame:
    check_features(features, models.features)
    names = set(models.features)
    return models.preparation.transform(features).select(
        *[c for c in features.columns if c not in names], "_vector")


def predict_hardness(features: DataFrame, models: MetaModels) -> DataFrame:
    """The key columns of ``features`` and ``is_hard``; the model says 1 for easy."""
    rows = _prepared(features, models)
    keys = [c for c in rows.columns if c != "_vector"]
    if models.classifier is None:
        return rows.select(*keys, F.lit(models.constant_easy == 0).alias("is_hard"))
    return models.classifier.transform(rows).select(*keys, (F.col("_easy") == 0).alias("is_hard"))


def estimate_model_f1(features: DataFrame, models: MetaModels, model: str) -> DataFrame:
    """The key columns of ``features`` and the estimated F1 of one family."""
    rows = _prepared(features, models)
    keys = [c for c in rows.columns if c != "_vector"]
    return models.regressors[model].transform(rows).select(*keys, F.col(MODEL_COLUMNS[model]).alias("est_f1"))


def estimate_f1(features: DataFrame, models: MetaModels) -> DataFrame:
    """``(keys..., model, est_f1)`` of all trained families in one pass."""
    rows = _prepared(features, models)
    keys = [c for c in rows.columns if c != "_vector"]
    for regressor in models.regressors.values():
        rows = regressor.transform(rows)
    names = F.create_map(*[x for m in models.regressors for x in (F.lit(MODEL_COLUMNS[m]), F.lit(m))])
    return (rows.unpivot(keys, [MODEL_COLUMNS[m] for m in models.regressors], "_c", "est_f1")
            .select(*keys, names[F.col("_c")].alias("model"), "est_f1"))
