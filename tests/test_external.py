from itertools import combinations
from math import comb, log, sqrt

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from tablegauge.operators import contingency as ct
from tablegauge.operators.external import EXTERNAL_INDICES, external_indices, weighted_f


def frame(spark, classes, clusters):
    return spark.createDataFrame(list(zip(classes, clusters)), "label int, cluster int")


def values(df):
    return {r["index_name"]: r["value"] for r in df.collect()}


def brute_pairs(classes, clusters):
    counts = {"TP": 0, "FN": 0, "FP": 0, "TN": 0}
    for i, j in combinations(range(len(classes)), 2):
        a, b = classes[i] == classes[j], clusters[i] == clusters[j]
        counts["TP" if a and b else "FN" if a else "FP" if b else "TN"] += 1
    return counts


@pytest.fixture(scope="module")
def labels():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 3, 80)
    clusters = np.where(rng.random(80) < 0.6, classes, rng.integers(0, 4, 80))
    return [int(v) for v in classes], [int(v) for v in clusters]


def test_pair_confusion_equals_the_pair_loop(spark, labels):
    cells = ct.contingency(frame(spark, *labels), "label", "cluster")
    row = ct.pair_confusion(ct.summarize(cells)).first()
    assert {k: int(row[k]) for k in ("TP", "FN", "FP", "TN")} == brute_pairs(*labels)


def test_pair_counts_stay_exact_for_huge_tables(spark):
    cells = spark.createDataFrame([(0, 0, 6 * 10 ** 10), (1, 1, 4 * 10 ** 10), (0, 1, 1)],
                                  "class int, cluster int, n bigint")
    row = ct.pair_confusion(ct.summarize(cells)).first()
    assert int(row["TP"]) == comb(6 * 10 ** 10, 2) + comb(4 * 10 ** 10, 2)
    assert int(row["TP"] + row["FN"] + row["FP"] + row["TN"]) == comb(10 ** 11 + 1, 2)


def test_formulas_from_pair_counts(spark, labels):
    got, c = values(external_indices(frame(spark, *labels))), brute_pairs(*labels)
    tp, fn, fp, tn = c["TP"], c["FN"], c["FP"], c["TN"]
    m = tp + fn + fp + tn
    expected = {
        "Precision": tp / (tp + fp), "Recall": tp / (tp + fn), "F": 2 * tp / (2 * tp + fn + fp),
        "Folkes-Mallows": tp / sqrt((tp + fp) * (tp + fn)), "Rand": (tp + tn) / m,
        "Jaccard": tp / (tp + fn + fp), "Kulczynski": (tp / (tp + fp) + tp / (tp + fn)) / 2,
        "McNemar": (tn - fp) / sqrt(tn + fp), "Russel-Rao": tp / m,
        "Phi": (tp * tn - fn * fp) / ((tp + fn) * (tp + fp) * (fn + tn) * (fp + tn)),
        "Rogers-Tanimoto": (tp + tn) / (tp + tn + 2 * (fn + fp)),
        "Sokal-Sneath1": tp / (tp + 2 * (fn + fp)), "Sokal-Sneath2": (tp + tn) / (tp + tn + (fn + fp) / 2),
        "Hubert Γ̂": (m * tp - (tp + fp) * (tp + fn)) / sqrt((tp + fp) * (tp + fn) * (m - tp - fp) * (m - tp - fn)),
    }
    for name, value in expected.items():
        assert got[name] == pytest.approx(value, rel=1e-9), name


def test_expected_mutual_info_equals_the_sum_over_permutations(spark):
    classes, clusters = [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2]
    rng, total, n = np.random.default_rng(0), 0.0, 6
    from itertools import permutations

    def mi(a, b):
        s = 0.0
        for x in set(a):
            for y in set(b):
                k = sum(1 for u, v in zip(a, b) if u == x and v == y)
                if k:
                    s += k / n * log(n * k / (a.count(x) * list(b).count(y)))
        return s

    all_b = list(permutations(clusters))
    expected = np.mean([mi(classes, b) for b in all_b])
    h = -2 * 0.5 * log(0.5)
    k = -3 * (1 / 3) * log(1 / 3)
    ami = (mi(classes, clusters) - expected) / ((h + k) / 2 - expected)
    got = values(external_indices(frame(spark, classes, clusters), names=["Adjusted-Mutual-Info"]))
    assert got["Adjusted-Mutual-Info"] == pytest.approx(ami, rel=1e-9)


def test_identical_labelings_are_perfect(spark, labels):
    got = values(external_indices(frame(spark, labels[0], labels[0])))
    for name in ("Purity", "Precision", "Recall", "F", "Rand", "Adjusted-Rand", "Adjusted-Mutual-Info",
                 "Normalized-Mutual-Info", "Homogeneity", "Completeness", "V-Measure", "Jaccard", "Hubert Γ̂"):
        assert got[name] == pytest.approx(1.0, abs=1e-9), name
    assert got["Entropy"] == pytest.approx(0.0, abs=1e-12)


def test_names_of_clusters_do_not_matter(spark, labels):
    swapped = [(v + 1) % 4 for v in labels[1]]
    assert values(external_indices(frame(spark, *labels), noise=None)) == pytest.approx(
        values(external_indices(frame(spark, labels[0], swapped), noise=None)))


def test_entropy_of_noise(spark):
    rows = frame(spark, [0, 1, 0, 1, 0, 0], [-1, -1, 0, 0, 1, 1])
    dropped = values(external_indices(rows, names=["Entropy"]))["Entropy"]
    kept = values(external_indices(rows, names=["Entropy"], noise=None))["Entropy"]
    assert dropped == pytest.approx(2 / 6) and kept == pytest.approx(4 / 6)


def test_one_class_and_one_cluster(spark):
    got = values(external_indices(frame(spark, [0, 0, 0], [1, 1, 1])))
    assert got["Adjusted-Rand"] == 1 and got["Homogeneity"] == 1 and got["Phi"] is None


def test_groups_are_independent(spark, labels):
    rows = frame(spark, *labels).withColumn("g", F.lit(1)).unionByName(
        frame(spark, labels[1], labels[0]).withColumn("g", F.lit(2)))
    got = external_indices(rows, by=["g"]).where("g = 1").drop("g")
    assert values(got) == pytest.approx(values(external_indices(frame(spark, *labels))), nan_ok=True)


def test_weighted_f_favours_recall(spark, labels):
    c = brute_pairs(*labels)
    got = weighted_f(frame(spark, *labels), "label", "cluster", 2.0).first()["value"]
    assert got == pytest.approx(5 * c["TP"] / (5 * c["TP"] + 4 * c["FN"] + c["FP"]))


def test_unknown_index(spark, labels):
    with pytest.raises(KeyError):
        external_indices(frame(spark, *labels), names=["Nope"])


def test_no_pair_is_formed(spark, labels):
    text = plan_of(external_indices(frame(spark, *labels), names=list(EXTERNAL_INDICES)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_modes_take_the_smaller_class_on_ties(spark):
    cells = ct.contingency(frame(spark, [1, 0, 2, 2], [0, 0, 1, 1]), "label", "cluster")
    assert {r["cluster"]: r["mode"] for r in ct.cluster_modes(cells).collect()} == {0: 0, 1: 2}
