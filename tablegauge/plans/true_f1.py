"""True F1 of six classifier families: stratified split, 5-fold grid search, weighted F1.

Every family is searched on 70 % of the rows and measured on the rest; while the minority
class is not learned, the rows are split again.
"""

from __future__ import annotations

import threading
import warnings
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.kernels import RandomFourier, TensorSketch
from tablegauge.functions.vectors import as_vector
from tablegauge.operators.boosted_cells import search_counts
from tablegauge.operators.classes import class_roles
from tablegauge.operators.linear_models import fit_many, fold_counts, hinge, logistic, pack_labelled, predict
from tablegauge.operators.neighbors import fold_neighbors, nearest_neighbors, vote
from tablegauge.operators.sampling import stratified_folds, stratified_split
from tablegauge.operators.scores import WeightedF1Evaluator, f1_of_counts, weighted_f1
from tablegauge.operators.tree_prefixes import fit_folds, prefix_counts
from tablegauge.session import materialize

FOLDS = 5
MAX_TRIES = 15
#: Families searched at a time: each is a chain of short jobs, the longest of which sets the time.
SIDE_BY_SIDE = 6
#: Deepest tree the built-in learners accept.
MAX_TREE_DEPTH = 30

# The search grids.
LR_C = (1e-3, 1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3)
SVM_C = (1e-2, 1e-1, 1.0, 1e1, 1e2)
RF_TREES = (1, 3, 7, 10)
KNN_K = (3, 5, 7, 9)
BOOST_RATES = (0.05, 0.175, 0.3)
BOOST_DEPTHS = (1, 2, 4, 8, 16, 30)
DEPTH_SHARES = (1.0, 0.75, 0.5, 0.25)
POLY_DEGREES = (2, 3, 4, 5)
#: Hashed features of a kernel, and scans of the rows for one search over linear models.
KERNEL_FEATURES, LINEAR_SCANS = 256, 100


class ClassesNotLearned(Exception):
    """No attempt predicted both classes."""


class Split(NamedTuple):
    train: DataFrame
    test: DataFrame
    n_train: int
    ratio: float
    majority: float
    minority: float


def split_rows(df: DataFrame, seed: int, folds: int = FOLDS) -> Split:
    """Train rows with ``fold``, ``balanced`` (n / 2 n_c) and ``boosted`` (R or 1) weights; test rows.

    ``df`` has ``row_id``, ``features ARRAY<DOUBLE>`` and a 0/1 ``label``.
    """
    cut = stratified_split(df, 0.3, "label", "row_id", seed)
    rows = cut.withColumn("label", F.col("label").cast("double")).withColumn("vector", as_vector("features"))
    train = stratified_folds(rows.where(~F.col("is_test")), folds, "label", "row_id", seed)
    roles = class_roles(train).first()
    if roles is None:
        raise ValueError("the training rows hold fewer than two classes")
    n, big, small = roles["n_majority"] + roles["n_minority"], roles["n_majority"], roles["n_minority"]
    minority = F.col("label") == roles["minority"]
    train = train.withColumns({"balanced": F.when(minority, n / (2.0 * small)).otherwise(n / (2.0 * big)),
                               "boosted": F.when(minority, big / small).otherwise(1.0)})
    return Split(materialize(train), materialize(rows.where("is_test")), n, big / small,
                 roles["majority"], roles["minority"])


class Splits:
    """The splits of a table by seed, each made once for all families that ask for it."""

    def __init__(self, df: DataFrame):
        self.df, self.made, self.lock = df, {}, threading.Lock()

    def __call__(self, seed: int) -> Split:
        with self.lock:
            if seed not in self.made:
                self.made[seed] = split_rows(self.df, seed)
            return self.made[seed]


def search(estimator, grid: list[dict], split: Split, parallelism: int = 4):
    """The best model of the grid by 5-fold weighted F1, refitted on all training rows."""
    if len(grid) == 1:
        return estimator.copy(grid[0]).fit(split.train)
    validator = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=WeightedF1Evaluator(),
                               numFolds=FOLDS, foldCol="fold", parallelism=parallelism)
    return validator.fit(split.train).bestModel


def _measure(predicted: DataFrame) -> tuple[float, float, float]:
    """(weighted, majority, minority) F1 of predicted rows or of confusion counts."""
    row = (f1_of_counts(predicted) if "n" in predicted.columns else weighted_f1(predicted)).first()
    return (row["weighted_f1"], row["f1_majority"], row["f1_minority"]) if row else (0.0, 0.0, 0.0)


def _with_retries(df: DataFrame, seed: int, attempt: Callable[[Split, int], DataFrame],
                  max_tries: int, splits: Splits | None, both: bool = False) -> float | None:
    splits = splits or Splits(df)
    for i in range(max_tries):
        weighted, majority, minority = _measure(attempt(splits(seed + i), i))
        if minority > 0 and (majority > 0 or not both):
            return weighted
    return None


def _depths(depth: int) -> list[int]:
    """Shares of the depth of a full fit, without zeros and repeats."""
    depth = max(1, depth)
    return [d for d in dict.fromkeys(int(share * depth) for share in DEPTH_SHARES) if d > 0]


def _common(weight: str) -> dict:
    return {"featuresCol": "vector", "labelCol": "label", "weightCol": weight}


def _best_point(counts: DataFrame, axes: Sequence[str], order: Sequence[tuple]) -> tuple:
    """The grid point with the best mean of the folds' weighted F1; of equal ones the first in ``order``.

    A fold in which a class is missing counts 0.
    """
    folds = f1_of_counts(counts, by=[*axes, "fold"]).groupBy(*axes).agg(F.sum("weighted_f1").alias("score"))
    # One row per grid point.
    scored = {tuple(r[a] for a in axes): r["score"] for r in folds.collect()}
    return max(order, key=lambda point: scored.get(point, 0.0))


def _cut_f1(df: DataFrame, seed: int, learner, depths: Sequence[int] | None, sizes: Sequence[int], max_tries: int,
            splits: Splits | None) -> float | None:
    """Search over depths and numbers of trees by one deep fit per fold."""
    learner = learner.copy({learner.maxDepth: min(MAX_TREE_DEPTH, max(depths))} if depths else {})

    def attempt(split: Split, i: int) -> DataFrame:
        models = fit_folds(learner.fit, split.train, FOLDS)
        found = list(depths or _depths(models[-1].depth()))
        counts = prefix_counts(split.train, models, found, sizes)
        size, depth = _best_point(counts, ["size", "depth"], [(m, d) for m in sizes for d in found])
        # The best point's model of all training rows is a prefix of the deep one.
        whole = prefix_counts(split.test.withColumn("fold", F.lit(-1)), {-1: models[-1]}, [depth], [size])
        return whole.select("label", "prediction", "n")

    return _with_retries(df, seed, attempt, max_tries, splits)


def decision_tree_f1(df: DataFrame, seed: int = 42, depths: Sequence[int] | None = None,
                     max_tries: int = MAX_TRIES, splits: Splits | None = None) -> float | None:
    tree = DecisionTreeClassifier(**_common("balanced"), maxDepth=MAX_TREE_DEPTH, seed=seed)
    return _cut_f1(df, seed, tree, depths, [1], max_tries, splits)


def random_forest_f1(df: DataFrame, seed: int = 42, depths: Sequence[int] | None = None,
                     trees: Sequence[int] = RF_TREES, max_tries: int = MAX_TRIES, splits: Splits | None = None) -> float | None:
    forest = RandomForestClassifier(**_common("balanced"), maxDepth=MAX_TREE_DEPTH, seed=seed,
                                    featureSubsetStrategy="sqrt", numTrees=max(trees))
    return _cut_f1(df, seed, forest, depths, list(trees), max_tries, splits)


def _linear_f1(split: Split, train: DataFrame, kernels: Sequence[Callable | None], cs: Sequence[float], loss: Callable,
               penalty: str, max_scans: int) -> DataFrame:
    """Test rows predicted by the best kernel and C; per kernel all folds and penalties share their scans."""
    best = None
    for kernel in kernels:
        # What is narrower is packed: the rows or their kernel features.
        late = kernel if kernel is not None and kernel.width <= kernel.n_components else None
        blocks = pack_labelled(train, "weight", None if late else kernel)
        models = fit_many(blocks, cs, FOLDS, loss, penalty, max_scans, features=late)
        counts = fold_counts(blocks, models, late)
        (c,) = _best_point(counts, ["cost"], [(float(c),) for c in cs])
        scores = f1_of_counts(counts.where(F.col("cost") == c), by=["fold"]).agg(F.sum("weighted_f1")).first()[0] or 0.0
        if best is None or scores > best[0]:
            best = scores, kernel, models.one(-1, c)
    _, kernel, (coefficients, intercept) = best
    return predict(split.test, coefficients, intercept, kernel)


def logistic_regression_f1(df: DataFrame, seed: int = 42, cs: Sequence[float] = LR_C, max_scans: int = LINEAR_SCANS,
                           max_tries: int = MAX_TRIES, splits: Splits | None = None) -> float | None:
    """L1 penalty."""
    def attempt(split: Split, i: int) -> DataFrame:
        return _linear_f1(split, split.train.withColumnRenamed("balanced", "weight"), [None], cs, logistic, "l1", max_scans)

    return _with_retries(df, seed, attempt, max_tries, splits)


def nearest_neighbor_f1(df: DataFrame, seed: int = 42, ks: Sequence[int] = KNN_K,
                        max_tries: int = MAX_TRIES, splits: Splits | None = None) -> float | None:
    """All folds and settings come from one neighbour scan of the training rows.

    With a test imbalance R of 10 or more, k is R and the minority wins above a share 1/R.
    """
    def attempt(split: Split, i: int) -> DataFrame:
        roles = class_roles(split.test).first()
        ratio = roles["imbalance_ratio"] if roles else split.ratio
        wanted, threshold = (list(ks), None) if ratio < 10 else ([round(ratio)], 1.0 / ratio)
        around = fold_neighbors(split.train, max(wanted))
        votes = vote(around, wanted, positive=split.minority, other=split.majority)
        labelled = votes.join(split.train.select("row_id", "label", "fold"), "row_id")
        scored = weighted_f1(labelled, by=["k", "weights", "fold"]).groupBy("k", "weights").agg(
            F.avg("weighted_f1").alias("score"))
        best = scored.orderBy(F.desc("score"), "k", F.desc("weights")).first()
        near = nearest_neighbors(split.test, split.train, best["k"])
        predicted = vote(near, [best["k"]], [best["weights"]], split.minority, threshold, split.majority)
        return predicted.join(split.test.select("row_id", "label"), "row_id")

    return _with_retries(df, seed, attempt, max_tries, splits)


def boosting_f1(df: DataFrame, seed: int = 42, rates: Sequence[float] = BOOST_RATES,
                depths: Sequence[int] = BOOST_DEPTHS, rounds: int = 100,
                max_tries: int = MAX_TRIES, splits: Splits | None = None) -> float | None:
    """All folds and grid points are boosted side by side over the cells of binned rows; tables of too many cells by the
    built-in learner, one point after another."""
    boosting = GBTClassifier(**_common("boosted"), maxIter=rounds, seed=seed)

    def attempt(split: Split, i: int) -> DataFrame:
        counts = search_counts(split.train, split.test, "boosted", rates, depths, rounds, FOLDS)
        if counts is not None:
            rate, depth = _best_point(counts.where("fold >= 0"), ["rate", "tree_depth"], [(float(r), int(d)) for r in rates for d in depths])
            best = counts.where((F.col("fold") < 0) & (F.col("rate") == rate) & (F.col("tree_depth") == depth))
            return best.select("label", "prediction", "n")
        grid = (ParamGridBuilder().addGrid(boosting.stepSize, list(rates))
                .addGrid(boosting.maxDepth, list(depths)).build())
        return search(boosting, grid, split).transform(split.test)

    return _with_retries(df, seed, attempt, max_tries, splits)


def kernel_width(df: DataFrame) -> tuple[float, int]:
    """(gamma, d) with gamma = 1 / (d * variance of all feature values)."""
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.first(F.size("features")).alias("d"),
        F.sum(F.aggregate("features", F.lit(0.0), lambda a, v: a + v)).alias("s"),
        F.sum(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v)).alias("q")).first()
    cells = sums["n"] * sums["d"]
    variance = sums["q"] / cells - (sums["s"] / cells) ** 2
    return (1.0 / (sums["d"] * variance) if variance > 0 else 1.0), sums["d"]


def _svm_weights(split: Split, i: int) -> tuple[float, float]:
    """(majority, minority) weights of the i-th attempt."""
    if i < 2 or i >= 12:
        return 1.0, 1.0
    if i < 5:
        return (1 + 1 / split.ratio) / 2, (1 + split.ratio) / 2
    if i < 8:
        return split.ratio / i, split.ratio + 2 * i
    return 1.0, split.ratio + 2 * i


def support_vector_f1(df: DataFrame, seed: int = 42, cs: Sequence[float] = SVM_C, n_components: int = KERNEL_FEATURES,
                      max_scans: int = LINEAR_SCANS, max_tries: int = MAX_TRIES, first_try: int = 0,
                      splits: Splits | None = None) -> float:
    """Linear SVM over explicit kernel features: random waves for the RBF kernel.

    Attempts weight the minority more and more; the last ones (from the 13th on) also try
    polynomials of every degree by hashed products.
    """
    gamma, width = kernel_width(df)

    def attempt(split: Split, i: int) -> DataFrame:
        i += first_try
        big, small = _svm_weights(split, i)
        weight = F.when(F.col("label") == split.minority, float(small)).otherwise(float(big))
        kernels: list[Callable | None] = [RandomFourier(width, n_components, seed + i, gamma)]
        if i >= 12:
            kernels += [TensorSketch(width, n_components, seed + i, degree, gamma) for degree in POLY_DEGREES]
        return _linear_f1(split, split.train.withColumn("weight", weight), kernels, cs, hinge, "l2", max_scans)

    value = _with_retries(df, seed, attempt, max_tries, splits, both=True)
    if value is None:
        raise ClassesNotLearned("no attempt learned both classes")
    return value


FAMILIES: dict[str, Callable[..., float | None]] = {
    "decision tree": decision_tree_f1,
    "random forest": random_forest_f1,
    "logistic regression": logistic_regression_f1,
    "k-nearest neighbor": nearest_neighbor_f1,
    "xgboost": boosting_f1,
    "support vector machine": support_vector_f1,
}


def true_f1_scores(df: DataFrame, models: Sequence[str] = tuple(FAMILIES), seed: int = 42,
                   options: dict[str, dict] | None = None) -> DataFrame:
    """``(model, true_f1)``; a family that cannot learn both classes is left out with a warning.

    The families share their splits and run side by side: most of their jobs are too short to fill the cores.
    """
    rows = materialize(df.select("row_id", "features", F.col("label").cast("double").alias("label")))
    splits = Splits(rows)

    def measure(model: str) -> tuple:
        try:
            return model, FAMILIES[model](rows, seed=seed, splits=splits, **(options or {}).get(model, {})), None
        except ClassesNotLearned as error:
            return model, None, error

    with ThreadPool(SIDE_BY_SIDE) as pool:
        found = pool.map(inheritable_thread_target(measure), models, 1)
    for model, _, error in found:
        if error:
            warnings.warn(f"{model}: {error}", stacklevel=2)
    results = [(model, value) for model, value, error in found if not error]
    return df.sparkSession.createDataFrame(results, "model string, true_f1 double")
