"""Boosting over cells of binned rows, against the built-in learner."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tablegauge.functions.vectors import as_vector
from tablegauge.operators import boosted_cells
from tablegauge.operators.boosted_cells import search_counts, thresholds_of
from tablegauge.operators.metafeatures import FEATURE_NAMES
from tablegauge.plans import catalogue, true_f1

RATES, DEPTHS, ROUNDS = [0.3, 0.05], [2, 30], 6


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(0, 1, 300), rng.integers(0, 9, 300), rng.exponential(2.0, 300)])
    label = (x[:, 0] + 0.2 * x[:, 1] * x[:, 2] + rng.normal(0, 1, 300) > 2).astype(float)
    data = [(i, [float(v) for v in x[i]], float(label[i]), i % 6 - 1, float(1 + label[i])) for i in range(300)]
    frame = spark.createDataFrame(data, "row_id bigint, features array<double>, label double, fold int, boosted double")
    return frame.withColumn("vector", as_vector("features")).cache()


def test_points_equal_the_built_in_learner(rows):
    train, test = rows.where("fold >= 0"), rows.where("fold < 0")
    counts = search_counts(train, test.drop("fold", "boosted"), "boosted", RATES, DEPTHS, ROUNDS, 5)
    got = {tuple(r)[:5]: r["n"] for r in counts.select("rate", "tree_depth", "fold", "label", "prediction", "n").collect()}
    assert sum(got.values()) == 300 * 4
    for rate, depth, fold in [(0.3, 2, -1), (0.05, 30, -1), (0.3, 30, 2), (0.05, 2, 4)]:
        learner = GBTClassifier(featuresCol="vector", weightCol="boosted", stepSize=rate, maxDepth=depth, maxIter=ROUNDS, seed=1)
        held = learner.fit(train.where(F.col("fold") != fold)).transform(rows.where(F.col("fold") == fold))
        own = {(r["label"], r["prediction"]): r["count"] for r in held.groupBy("label", "prediction").count().collect()}
        assert own == {k[3:]: n for k, n in got.items() if k[:3] == (rate, depth, fold)}


def test_thresholds():
    assert list(thresholds_of(np.array([1.0, 2.0, 4.0]), np.ones(3), 3)) == [1.5, 3.0]
    assert list(thresholds_of(np.arange(8.0), np.ones(8), 8, max_bins=4)) == [1.5, 3.5, 5.5]
    # A value heavier than its share is followed by the thresholds that are still due.
    assert list(thresholds_of(np.arange(8.0), np.array([1, 90, 1, 1, 1, 1, 1, 1.0]), 97, max_bins=4)) == [0.5, 1.5, 2.5]
    assert not len(thresholds_of(np.array([3.0]), np.ones(1), 9))


def test_both_ways_give_one_value(rows, monkeypatch):
    args = {"rates": [0.3], "depths": [2], "rounds": 4, "max_tries": 1}
    cells = true_f1.boosting_f1(rows.select("row_id", "features", "label"), **args)
    monkeypatch.setattr(boosted_cells, "CELL_LIMIT", 0)
    assert true_f1.boosting_f1(rows.select("row_id", "features", "label"), **args) == pytest.approx(cells)


def test_histograms_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 12, (400, 3)).astype(np.uint8)
    n, w1 = np.ones(400), rng.integers(0, 2, 400).astype(float)
    whole = boosted_cells.boost(bins, n, 1 - w1, w1, 0.3, 8, 5)
    monkeypatch.setattr(boosted_cells, "HISTOGRAM_CELLS", 40)
    assert np.allclose(boosted_cells.boost(bins, n, 1 - w1, w1, 0.3, 8, 5), whole)


def test_f1_all_boosts_the_whole_grid(spark, rows, monkeypatch):
    seen = []

    def boosting(df, seed, splits, rates=true_f1.BOOST_RATES, depths=true_f1.BOOST_DEPTHS, rounds=100, max_tries=true_f1.MAX_TRIES):
        seen.append((len(rates), len(depths), rounds, max_tries))
        return 1.0

    assert boosting.__defaults__ == true_f1.boosting_f1.__defaults__[1:-1]
    monkeypatch.setattr(true_f1, "FAMILIES", {m: boosting if m == "xgboost" else lambda df, seed, splits: 1.0 for m in true_f1.FAMILIES})
    monkeypatch.setattr(catalogue.fx, "document_points", lambda *_: rows.select("row_id", "features", "label"))
    assert catalogue.f1_all(spark, "").count() == 6
    assert seen == [(3, 6, 100, 15)]


def test_meta_models_come_from_whole_searches(spark, rows, monkeypatch):
    """No family is given a smaller grid or fewer attempts, no meta-model fewer or lower trees than usual."""
    seen = []
    monkeypatch.setattr(true_f1, "FAMILIES", {m: lambda df, seed, splits, **options: seen.append(options) or 0.5 for m in true_f1.FAMILIES})
    monkeypatch.setattr(catalogue.fx, "customers", lambda *_: rows.select("row_id", "features", "label"))
    monkeypatch.setattr(catalogue.sampling, "sample_table", lambda df: df.where("row_id < 30"))
    monkeypatch.setattr(catalogue, "metafeatures", lambda df: df.select(
        F.col("row_id").alias("bag_id"), *[F.rand(i).alias(n) for i, n in enumerate(FEATURE_NAMES)]))
    monkeypatch.setattr(catalogue, "_TRAINED", {})
    _, models = catalogue._meta(spark, "")
    assert seen == [{}] * 12
    assert [(r.getNumTrees, r.getMaxDepth()) for r in models.regressors.values()] == [(50, 8)] * 6
