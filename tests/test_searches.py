"""Searches that share fits and scans, against one fit per grid point."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from tablegauge.functions.kernels import RandomFourier, TensorSketch
from tablegauge.functions.vectors import as_vector
from tablegauge.operators import scans
from tablegauge.operators.linear_models import fit_many, fold_counts, hinge, logistic, pack_labelled, predict
from tablegauge.operators.tree_prefixes import fit_folds, flatten, prefix_counts
from tablegauge.plans import true_f1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, [1, 5, 0.2, 1, 1], (400, 5))
    label = (x[:, 0] + 0.3 * x[:, 1] + 4 * x[:, 2] ** 2 + rng.normal(0, 0.7, 400) > 0.4).astype(int)
    data = [(i, [float(v) for v in x[i]], float(label[i]), i % 5, float(1 + i % 3)) for i in range(400)]
    frame = spark.createDataFrame(data, "row_id bigint, features array<double>, label double, fold int, weight double")
    return x, frame.withColumn("vector", as_vector("features")).cache()


def common():
    return {"featuresCol": "vector", "labelCol": "label", "weightCol": "weight", "seed": 3}


def test_cut_trees_equal_fits_of_that_depth(rows):
    x, frame = rows
    deep = DecisionTreeClassifier(maxDepth=30, **common()).fit(frame)
    flat = flatten(deep)
    assert flat.depth() == deep.depth
    depths = list(range(0, deep.depth + 3))
    said = flat.answers(x, depths, [1])
    for d in depths:
        own = DecisionTreeClassifier(maxDepth=d, **common()).fit(frame).transform(frame).orderBy("row_id").toPandas()
        assert (said[d, 0] == own["prediction"].to_numpy()).all(), d


def test_forest_prefixes(rows):
    x, frame = rows
    forest = RandomForestClassifier(maxDepth=6, numTrees=7, **common()).fit(frame)
    flat = flatten(forest)
    said = flat.answers(x, [3, 6], [1, 4, 7])
    whole = forest.transform(frame).orderBy("row_id").toPandas()["prediction"].to_numpy()
    assert (said[1, 2] == whole).all()
    first = forest.trees[0].transform(frame).orderBy("row_id").toPandas()["prediction"].to_numpy()
    assert (said[1, 0] == first).all()
    assert (said[1, 1] != said[1, 0]).any()


def test_every_row_is_judged_by_the_model_that_left_it_out(rows):
    x, frame = rows
    tree = DecisionTreeClassifier(maxDepth=5, **common())
    models = fit_folds(tree.fit, frame, 5)
    assert set(models) == {-1, 0, 1, 2, 3, 4}
    got = {(r["fold"], r["depth"], r["label"], r["prediction"]): r["n"] for r in prefix_counts(frame, models, [2, 5], [1]).collect()}
    assert sum(got.values()) == 800
    for fold in range(5):
        own = tree.copy({tree.maxDepth: 2}).fit(frame.where(F.col("fold") != fold)).transform(frame.where(F.col("fold") == fold))
        for r in own.groupBy("label", "prediction").count().collect():
            assert got[fold, 2, r["label"], r["prediction"]] == r["count"]


def objective(x, y, w, mask, coefficients, intercept, loss, penalty, strength):
    cost, _ = loss((x @ coefficients + intercept) * y)
    own = w * mask
    size = np.abs(coefficients).sum() if penalty == "l1" else 0.5 * (coefficients**2).sum()
    return (cost * own).sum() / own.sum() + strength * size


@pytest.mark.parametrize("loss,penalty", [(logistic, "l1"), (hinge, "l2")])
def test_many_models_equal_single_fits(rows, loss, penalty):
    x, frame = rows
    y = np.where(np.array([r[0] for r in frame.orderBy("row_id").select("label").collect()]) > 0, 1.0, -1.0)
    fold, w = np.arange(400) % 5, 1.0 + np.arange(400) % 3
    cs = [0.01, 0.1, 1.0, 10.0]
    models = fit_many(pack_labelled(frame.repartition(3), "weight"), cs, 5, loss, penalty, max_scans=100, tolerance=1e-7)
    assert len(models.points) == 24 and models.scans <= 100
    for m, (out, c) in enumerate(models.points):
        mask = fold != out
        strength = 1 / (c * w[mask].sum())
        mine = objective(x, y, w, mask, models.coefficients[:, m], models.intercepts[m], loss, penalty, strength)
        assert mine == pytest.approx(models.objectives[m], rel=1e-6)
        if out in (-1, 2) and c in (0.01, 1.0):
            cls, extra = ((LogisticRegression, {"elasticNetParam": 1.0}) if penalty == "l1" else (LinearSVC, {}))
            keys = {k: v for k, v in common().items() if k != "seed"}
            own = cls(regParam=strength, standardization=False, maxIter=300, tol=1e-8, **keys, **extra).fit(frame.where(F.col("fold") != out))
            theirs = objective(x, y, w, mask, own.coefficients.toArray(), own.intercept, loss, penalty, strength)
            assert mine <= theirs * (1.0005 if penalty == "l1" else 1.01) + 1e-9
    sparse = np.abs(models.coefficients) < 1e-12
    if penalty == "l1":
        assert sparse[:, [c == 0.01 for _, c in models.points]].sum() > sparse[:, [c == 10.0 for _, c in models.points]].sum()


def test_sums_of_few_and_of_many_tasks_agree(rows, monkeypatch):
    _, frame = rows
    blocks = pack_labelled(frame.repartition(3), "weight")
    partial = lambda x, y, w, fold: (x * w[:, None]).T @ (x * y[:, None])
    one = scans.Scanner(blocks, ("y", "w", "fold"))
    monkeypatch.setattr(scans, "FEW_PARTITIONS", 0)
    two = scans.Scanner(blocks, ("y", "w", "fold"))
    assert one.few and not two.few and np.allclose(one.sum(partial), two.sum(partial))


def test_counts_of_linear_models(rows):
    x, frame = rows
    blocks = pack_labelled(frame, "weight")
    models = fit_many(blocks, [0.1, 5.0], 5)
    got = {(r["cost"], r["fold"], r["label"], r["prediction"]): r["n"] for r in fold_counts(blocks, models).collect()}
    assert sum(got.values()) == 800
    label = np.array([r[0] for r in frame.orderBy("row_id").select("label").collect()])
    w, b = models.one(3, 5.0)
    mine = np.arange(400) % 5 == 3
    said = (x[mine] @ w + b > 0).astype(float)
    for one in (0.0, 1.0):
        for two in (0.0, 1.0):
            assert got.get((5.0, 3, one, two), 0) == ((label[mine] == one) & (said == two)).sum()
    out = predict(frame, w, b).orderBy("row_id").toPandas()["prediction"].to_numpy()
    assert (out == (x @ w + b > 0)).all()


def test_columns_that_never_change_and_empty_tables(rows, spark):
    _, frame = rows
    flat = frame.withColumn("features", F.concat("features", F.array(F.lit(3.0), F.lit(0.0))))
    models = fit_many(pack_labelled(flat, "weight"), [1.0], 5)
    assert np.isfinite(models.coefficients).all() and (models.coefficients[5:] == 0).all()
    with pytest.raises(ValueError):
        fit_many(pack_labelled(frame.limit(0), "weight"), [1.0], 5)


def test_kernel_features_approximate_kernels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) / 2
    waves = np.mean([(z := RandomFourier(6, 2000, s, 0.4)(x)) @ z.T for s in range(3)], axis=0)
    true = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(waves - true).max() < 0.1
    for degree in (2, 3, 4, 5):
        for offset in (0.0, 1.0):
            hashed = np.mean([(z := TensorSketch(6, 1024, s, degree, 0.5, offset)(x)) @ z.T for s in range(40)], axis=0)
            true = (0.5 * x @ x.T + offset) ** degree
            assert np.abs(hashed - true).max() < 0.12 * np.abs(true).max(), (degree, offset)


def test_wide_tables_get_every_degree():
    x = np.random.default_rng(1).normal(size=(5, 3000))
    for degree in true_f1.POLY_DEGREES:
        assert TensorSketch(3000, 64, 7, degree, 1 / 3000)(x).shape == (5, 64)


@pytest.fixture(scope="module")
def rings(spark):
    """The minority is far from the origin in all directions: a polynomial parts it, a line does not."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.where(np.arange(300) < 90, 3.0, 1.0)[:, None]
    data = [(i, [float(v) for v in x[i]], int(i < 90)) for i in range(300)]
    return spark.createDataFrame(data, "row_id bigint, features array<double>, label int").cache()


def test_late_attempts_try_polynomials(rings, monkeypatch):
    seen = []
    inner = true_f1._linear_f1

    def spy(split, train, kernels, *rest):
        seen.append([type(k).__name__ for k in kernels])
        return inner(split, train, kernels, *rest)

    monkeypatch.setattr(true_f1, "_linear_f1", spy)
    assert true_f1.support_vector_f1(rings, cs=[10.0], n_components=64, max_scans=30, first_try=12, max_tries=1) > 0.95
    assert seen == [["RandomFourier"] + ["TensorSketch"] * 4]


def test_default_grids(rings):
    assert true_f1.decision_tree_f1(rings) > 0.9
    assert true_f1.random_forest_f1(rings) > 0.9
    assert true_f1.support_vector_f1(rings, max_scans=40) > 0.95
    # A line cannot part rings, so that both classes may not be learned.
    value = true_f1.logistic_regression_f1(rings, max_tries=1)
    assert value is None or value < 0.9


def test_kernel_features_are_made_in_the_scans(rows, monkeypatch):
    """Narrow rows are packed as they are; models and counts are those of packed kernel features."""
    x, frame = rows
    kernel, packed = RandomFourier(5, 32, 1, 0.1), []
    early = pack_labelled(frame, "weight", kernel)
    late = pack_labelled(frame, "weight")
    a = fit_many(early, [0.1, 1.0], 5, hinge, "l2", 15)
    b = fit_many(late, [0.1, 1.0], 5, hinge, "l2", 15, features=kernel)
    assert np.array_equal(a.coefficients, b.coefficients) and np.array_equal(a.intercepts, b.intercepts)
    key = ["cost", "fold", "label", "prediction"]
    assert fold_counts(early, a).orderBy(*key).collect() == fold_counts(late, b, kernel).orderBy(*key).collect()
    # The search itself packs five columns, not 32.
    pack = true_f1.pack_labelled
    monkeypatch.setattr(true_f1, "pack_labelled", lambda *args: packed.append(pack(*args)) or packed[-1])
    true_f1.support_vector_f1(frame, cs=[1.0], n_components=32, max_scans=10, splits=None)
    assert {r["width"] for df in packed for r in df.select("width").collect()} == {5}
