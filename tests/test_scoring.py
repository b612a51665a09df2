import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import metafeatures as mf
from tablegauge.operators import verdicts
from tablegauge.plans import scoring, true_f1
from tablegauge.plans.assess import assess, check_parameters


def test_feature_order():
    assert len(mf.FEATURE_ORDER) == len(set(mf.FEATURE_NAMES)) == 106
    assert mf.FEATURE_ORDER[0] == ("kmeans", "internal_indices", "Silhouette")
    assert mf.FEATURE_ORDER[-1] == ("hdbscan", "external_indices", "Sokal-Sneath2")


def test_votes_and_means(spark):
    hard = spark.createDataFrame([(True,), (False,)], "is_hard boolean")
    assert verdicts.vote_hardness(hard).first()[0] is True
    scores = spark.createDataFrame([("a", 0.5), ("a", 0.7)], "model string, est_f1 double")
    assert verdicts.mean_scores(scores).first()["est_f1"] == pytest.approx(0.6)


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(4)
    rows = [("easy" if i % 2 else "hard", i, *[float(v) for v in rng.normal(i % 2, 0.1, 106)]) for i in range(20)]
    table = spark.createDataFrame(rows, ["task", "bag_id", *mf.FEATURE_NAMES])
    table = table.withColumn(mf.FEATURE_NAMES[3], F.when(F.col("bag_id") > 4, F.col(mf.FEATURE_NAMES[3])))
    truth = spark.createDataFrame([(t, m, v) for t, v in (("easy", 0.9), ("hard", 0.4)) for m in verdicts.MODELS],
                                  "task string, model string, true_f1 double")
    return table, scoring.train_meta_models(scoring.meta_table(table, truth), trees=5, depth=3)


def test_meta_models(trained):
    table, models = trained
    hard = {r["task"] for r in scoring.predict_hardness(table, models).where("is_hard").collect()}
    assert hard == {"hard"}
    est = scoring.estimate_f1(table, models).groupBy("task", "model").agg(F.avg("est_f1").alias("f")).collect()
    assert len(est) == 12 and all(abs(r["f"] - (0.9 if r["task"] == "easy" else 0.4)) < 0.1 for r in est)
    one = scoring.estimate_model_f1(table, models, "random forest")
    assert one.columns == ["task", "bag_id", "est_f1"] and one.count() == 20
    with pytest.raises(ValueError):
        scoring.predict_hardness(table.drop(mf.FEATURE_NAMES[0]), models)


def test_meta_models_are_fitted_side_by_side(trained, monkeypatch):
    table, _ = trained
    meet, fit = threading.Barrier(len(verdicts.MODELS)), scoring.RandomForestRegressor.fit

    def waiting(self, rows):
        meet.wait(60)  # breaks if one fit ends before another begins
        return fit(self, rows)

    monkeypatch.setattr(scoring.RandomForestRegressor, "fit", waiting)
    truth = table.sparkSession.createDataFrame(
        [("easy", m, 0.9) for m in verdicts.MODELS] + [("hard", "random forest", 0.4)], "task string, model string, true_f1 double")
    models = scoring.train_meta_models(scoring.meta_table(table, truth), trees=2, depth=2)
    assert list(models.regressors) == list(verdicts.MODELS) and models.classifier is not None
    found = scoring.estimate_f1(table.where("task = 'easy'"), models).groupBy("model").agg(F.avg("est_f1").alias("f")).collect()
    assert len(found) == 6 and all(abs(r["f"] - 0.9) < 0.15 for r in found)


def test_families_are_searched_side_by_side(spark, monkeypatch):
    meet = threading.Barrier(len(true_f1.FAMILIES))
    monkeypatch.setattr(true_f1, "FAMILIES", {m: lambda rows, seed, splits: float(meet.wait(60) >= 0) for m in true_f1.FAMILIES})
    rows = spark.createDataFrame([(1, [0.0], 0)], "row_id bigint, features array<double>, label int")
    assert true_f1.true_f1_scores(rows).where("true_f1 = 1").count() == 6


def blobs(spark, n):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(3 * (i % 2), 1.0, 2)], i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, features array<double>, label int")


def test_assessment_in_bags_and_at_once(spark, trained, tmp_path):
    found = assess(blobs(spark, 520), trained[1], oneshot=False)
    assert found.features.count() == 16 and found.estimated_f1.count() == 6
    report = found.report.collect()
    assert sum(r["bag"] == "Dataset" for r in report) == 1 and len(report) == 17
    run = found.write(str(tmp_path / "out"), "r1")
    assert spark.read.parquet(str(tmp_path / "out" / "results")).where(F.col("run_id") == run).count() == 7
    once = assess(blobs(spark, 120), trained[1])
    assert once.features.count() == 1
    row = once.features.first()
    assert row["kmeans_external_adjusted_rand"] > 0.8 and row["hierarchical_external_purity"] > 0.9
    with pytest.raises(ValueError):
        assess(blobs(spark, 100), trained[1], oneshot=False)
    with pytest.raises(ValueError):
        assess(blobs(spark, 60).withColumn("label", F.col("row_id") % 3), trained[1])
    with pytest.raises(TypeError):
        check_parameters("yes", False)
