import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators.neighbors import fold_neighbors, nearest_neighbors, vote
from tablegauge.operators.scores import WeightedF1Evaluator, weighted_f1
from tablegauge.plans import true_f1


def test_weighted_f1(spark):
    rows = spark.createDataFrame([(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)], "label int, prediction int")
    row = weighted_f1(rows).first()
    big, small = 12 / 15, 6 / 9
    assert row["f1_majority"] == pytest.approx(big) and row["f1_minority"] == pytest.approx(small)
    assert row["weighted_f1"] == pytest.approx((big + 2 * small) / 3)
    assert WeightedF1Evaluator().evaluate(rows) == pytest.approx(row["weighted_f1"])
    assert WeightedF1Evaluator().evaluate(rows.where("label = 0")) == 0.0
    never = rows.withColumn("prediction", F.lit(0))
    assert weighted_f1(never).first()["f1_minority"] == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (90, 3)), rng.normal(1.5, 1, (60, 3))])
    rows = [(i, [float(v) for v in r], int(i >= 90)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "row_id bigint, features array<double>, label int").cache()


def test_neighbors_equal_brute_force(points):
    x, rows = points
    test, train = rows.where("row_id % 3 = 0"), rows.where("row_id % 3 > 0")
    got = nearest_neighbors(test, train, 4, block_rows=32).orderBy("row_id", "rank").collect()
    ids = [i for i in range(150) if i % 3]
    for i in range(0, 150, 3):
        d = np.sqrt(((x[i] - x[ids]) ** 2).sum(1))
        expected = [ids[j] for j in np.argsort(d, kind="stable")[:4]]
        assert [r["neighbor"] for r in got if r["row_id"] == i] == expected


def test_folds_exclude_their_own_rows(points):
    _, rows = points
    folded = rows.withColumn("fold", F.col("row_id") % 5)
    near = fold_neighbors(folded, 3, block_rows=32)
    assert near.count() == 450
    assert near.where("row_id % 5 = neighbor % 5").count() == 0


def test_votes(spark):
    near = spark.createDataFrame([(1, 0.0, 1.0, 1), (1, 1.0, 0.0, 2), (1, 1.0, 0.0, 3), (2, 1.0, 1.0, 1), (2, 3.0, 0.0, 2)],
                                 "row_id int, distance double, label double, rank int")
    got = {(r["row_id"], r["weights"]): (r["share"], r["prediction"]) for r in vote(near, [3]).collect()}
    assert got[(1, "uniform")] == (pytest.approx(1 / 3), 0.0) and got[(1, "distance")] == (1.0, 1.0)
    assert got[(2, "uniform")] == (0.5, 0.0) and got[(2, "distance")] == (pytest.approx(0.75), 1.0)
    eager = vote(near, [3], ["uniform"], threshold=0.2)
    assert {r["prediction"] for r in eager.collect()} == {1.0}


OPTIONS = {"decision tree": {"depths": [3]}, "random forest": {"depths": [3], "trees": [5]},
           "logistic regression": {"cs": [1.0]}, "k-nearest neighbor": {"ks": [5]},
           "xgboost": {"rates": [0.3], "depths": [2], "rounds": 5},
           "support vector machine": {"cs": [10.0], "n_components": 64, "max_scans": 30}}


def test_every_family_learns_separated_classes(points):
    scores = {r["model"]: r["true_f1"] for r in true_f1.true_f1_scores(points[1], options=OPTIONS).collect()}
    assert set(scores) == set(true_f1.FAMILIES)
    assert all(0.7 < v <= 1 for v in scores.values()), scores


def test_grid_search_uses_folds(points):
    assert true_f1.decision_tree_f1(points[1], depths=[1, 3]) > 0.7


def test_hopeless_classes(points):
    rows = points[1].withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    # Features without information: all 24 test rows are put into the class of 22 of them.
    hopeless = rows.withColumn("label", (F.col("row_id") < 5).cast("int"))
    assert true_f1.decision_tree_f1(hopeless, depths=[1], max_tries=1) == pytest.approx(2 * 22 / (2 * 22 + 2) / (1 + 22 / 2))
    with pytest.raises(true_f1.ClassesNotLearned):
        true_f1.support_vector_f1(rows, cs=[1.0], n_components=4, max_scans=3, max_tries=1)


def test_depth_shares():
    assert true_f1._depths(12) == [12, 9, 6, 3] and true_f1._depths(1) == [1] and true_f1._depths(0) == [1]


def test_families_share_their_splits(spark, monkeypatch):
    """Every attempt's split is made once, however many families ask for it."""
    from tablegauge.plans import true_f1

    made = []
    split_rows = true_f1.split_rows
    monkeypatch.setattr(true_f1, "split_rows", lambda df, seed, *rest: made.append(seed) or split_rows(df, seed, *rest))
    rows = spark.createDataFrame([(i, [float(i % 2 * 10 + i % 7), float(i % 5)], i % 2) for i in range(120)],
                                 "row_id bigint, features array<double>, label int")
    found = true_f1.true_f1_scores(rows, ["decision tree", "logistic regression", "k-nearest neighbor"],
                                   options={"decision tree": {"depths": [2]}, "logistic regression": {"cs": [1.0]}})
    assert [tuple(r) for r in found.collect()] == [
        ("decision tree", 1.0), ("logistic regression", 1.0), ("k-nearest neighbor", 1.0)]
    assert made == [42]
