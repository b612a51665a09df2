from itertools import combinations
from math import exp, log, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import pairs
from tablegauge.operators.blocks import scan_pairs
from tablegauge.operators.internal import INTERNAL_INDICES, internal_indices
from tablegauge.operators.moments import scatter_matrices


def frame(spark, x, labels):
    return spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))],
                                 "row_id bigint, features array<double>, cluster int")


def values(df):
    return {r["index_name"]: r["value"] for r in df.collect()}


def brute(x, labels):
    """All indices straight from their definitions."""
    n, ks = len(x), np.unique(labels)
    k, m = len(ks), x.mean(0)
    parts = [x[labels == c] for c in ks]
    cents = [p.mean(0) for p in parts]
    w_k = [(p - c).T @ (p - c) for p, c in zip(parts, cents)]
    w, t = sum(w_k), (x - m).T @ (x - m)
    wgss, bgss = np.trace(w), np.trace(t) - np.trace(w)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = [(d[i, j], labels[i] == labels[j]) for i, j in combinations(range(n), 2)]
    within = [v for v, s in pairs if s]
    ordered, nw = sorted(v for v, _ in pairs), len(within)
    sil = []
    for i in range(n):
        own = [d[i, j] for j in range(n) if labels[j] == labels[i] and j != i]
        b = min(np.mean([d[i, j] for j in range(n) if labels[j] == c]) for c in ks if c != labels[i])
        sil.append((b - np.mean(own)) / max(b, np.mean(own)) if own else 0.0)
    s = [np.mean(np.sqrt(((p - c) ** 2).sum(1))) for p, c in zip(parts, cents)]
    cd = np.array([[sqrt(((a - b) ** 2).sum()) for b in cents] for a in cents])
    worst = [max((s[i] + s[j]) / cd[i, j] for j in range(k) if j != i) for i in range(k)]
    off = cd[~np.eye(k, dtype=bool)]
    ew = sum(np.sqrt(((p - c) ** 2).sum(1)).sum() for p, c in zip(parts, cents))
    et = np.sqrt(((x - m) ** 2).sum(1)).sum()
    bcd = sum(len(p) * sqrt(((c - m) ** 2).sum()) for p, c in zip(parts, cents)) / (k * n)
    return {
        "WGSS": wgss, "BGSS": bgss, "Ball-Hall": sum(np.trace(v) / len(p) for v, p in zip(w_k, parts)) / k,
        "Banfeld-Raftery": sum(len(p) * log(np.trace(v) / len(p)) for v, p in zip(w_k, parts) if np.trace(v)),
        "Log-SS-Ratio": log(bgss / wgss), "Calinski-Harabasz": (n - k) / (k - 1) * bgss / wgss,
        "Det-Ratio": np.linalg.det(t) / np.linalg.det(w), "Ksq-DetW": k * k * np.linalg.det(w),
        "Log-Det-Ratio": n * log(np.linalg.det(t) / np.linalg.det(w)),
        "Trace-WiB": np.trace(np.linalg.inv(w) @ (t - w)),
        "Scott-Symons": sum(len(p) * log(np.linalg.det(v / len(p))) for v, p in zip(w_k, parts)),
        "Silhouette": np.mean(sil), "C": (sum(within) - sum(ordered[:nw])) / (sum(ordered[-nw:]) - sum(ordered[:nw])),
        "Dunn": min(v for v, s_ in pairs if not s_) / max(within), "Davies-Bouldin": np.mean(worst),
        "Ray-Turi": wgss / (n * off.min() ** 2), "PBM": (et * off.max() / (k * ew)) ** 2,
        "Score": 1 - 1 / exp(exp(bcd - sum(s))),
    }


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 1.0, size=(25, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 1))])
    return x, np.repeat([0, 1, 2], 25)


def test_all_indices_against_their_definitions(spark, points):
    got = values(internal_indices(frame(spark, *points), names=[n for n in INTERNAL_INDICES if n != "Hartigan"]))
    for name, value in brute(*points).items():
        assert got[name] == pytest.approx(value, rel=1e-8), name


def test_block_scan_equals_one_block(spark, points):
    names = ["Silhouette", "C", "Dunn", "Davies-Bouldin", "PBM"]
    rows = frame(spark, *points)
    many = values(internal_indices(rows, names=names, block_rows=16))
    assert many == pytest.approx(values(internal_indices(rows, names=names)), rel=1e-9)


def test_c_index_with_tied_distances_over_blocks(spark):
    grid = np.array([[i, j] for i in range(8) for j in range(8)], dtype=float)
    labels = (grid[:, 0] > 3).astype(int)
    got = values(internal_indices(frame(spark, grid, labels), names=["C", "Dunn"], block_rows=10))
    expected = brute(grid, labels)
    assert got["C"] == pytest.approx(expected["C"]) and got["Dunn"] == pytest.approx(expected["Dunn"])


def test_few_boundary_distances_need_one_more_scan(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(90, 3))
    labels = np.arange(90) % 4
    scans = []

    def counted(*args, **kwargs):
        scans.append(1)
        return scan_pairs(*args, **kwargs)

    monkeypatch.setattr(pairs, "scan_pairs", counted)
    monkeypatch.setattr(pairs, "BUCKETS", 4)
    df = frame(spark, x, labels)
    found = pairs.pair_indices(df, block_rows=20, names=["C"]).first()["C"]
    assert len(scans) == 2 and found == pytest.approx(brute(x, labels)["C"], rel=1e-9)


def test_groups_of_unequal_size(spark, points):
    rows = frame(spark, *points).withColumn("g", F.lit(1)).unionByName(
        frame(spark, points[0][::5], points[1][::5]).withColumn("g", F.lit(2)))
    names = ["Silhouette", "C", "Dunn", "WGSS", "Score", "Ray-Turi", "Det-Ratio"]
    got = internal_indices(rows, names=names, by=["g"], block_rows=30)
    for g, (x, c) in ((1, points), (2, (points[0][::5], points[1][::5]))):
        part, expected = values(got.where(f"g = {g}").drop("g")), brute(x, c)
        for name in names:
            assert part[name] == pytest.approx(expected[name], rel=1e-8), (g, name)


def test_single_row_cluster(spark):
    x, labels = np.array([[0.0, 0], [0, 1], [5, 5], [6, 5], [20, 20]]), np.array([0, 0, 1, 1, 2])
    got = values(internal_indices(frame(spark, x, labels), names=["Silhouette", "Banfeld-Raftery", "Scott-Symons"]))
    assert got["Silhouette"] == pytest.approx(np.mean([*_silhouettes(x, labels)]))
    assert got["Banfeld-Raftery"] == pytest.approx(4 * log(0.25)) and got["Scott-Symons"] is None


def _silhouettes(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        own = [d[i, j] for j in range(len(x)) if labels[j] == labels[i] and j != i]
        b = min(np.mean(d[i][labels == c]) for c in np.unique(labels) if c != labels[i])
        yield (b - np.mean(own)) / max(b, np.mean(own)) if own else 0.0


def test_identical_rows(spark):
    got = values(internal_indices(frame(spark, np.ones((6, 2)), np.array([0, 0, 0, 1, 1, 1])),
                                  names=["Dunn", "Det-Ratio", "Log-Det-Ratio", "PBM", "C", "Silhouette"]))
    assert got["Dunn"] == 0 and got["C"] is None and got["Silhouette"] == 0
    assert got["Det-Ratio"] == got["Log-Det-Ratio"] == got["PBM"] == 1e-20


def test_hartigan_falls_when_the_number_fits(spark, points):
    good = values(internal_indices(frame(spark, *points), names=["Hartigan"]))["Hartigan"]
    merged = np.where(points[1] == 2, 1, points[1])
    assert values(internal_indices(frame(spark, points[0], merged), names=["Hartigan"]))["Hartigan"] > good > 0


def test_scatter_matrices(spark, points):
    rows = scatter_matrices(frame(spark, *points)).collect()
    x = points[0][points[1] == 1]
    expected = (x - x.mean(0)).T @ (x - x.mean(0))
    got = np.array([r["row"] for r in sorted((r for r in rows if r["cluster"] == "1"), key=lambda r: r["i"])])
    assert np.allclose(got, expected)


def test_wide_scatter_equals_narrow(spark, points, monkeypatch):
    from tablegauge.operators import moments
    names = ["Det-Ratio", "Trace-WiB", "Scott-Symons"]
    narrow = values(internal_indices(frame(spark, *points), names=names))
    monkeypatch.setattr(moments, "EXPRESSION_WIDTH", 0)
    assert values(internal_indices(frame(spark, *points), names=names)) == pytest.approx(narrow)


def test_unknown_index(spark, points):
    with pytest.raises(KeyError):
        internal_indices(frame(spark, *points), names=["Nope"])


def test_row_sums_come_back_once_per_row_of_a_block(spark):
    rng = np.random.default_rng(21)
    x, labels = rng.normal(size=(300, 20)), rng.integers(0, 9, 300)
    rows = frame(spark, x, labels).withColumn("cluster", F.when(F.col("row_id") % 7 > 0, F.col("cluster").cast("string")))
    clusters = pairs._few_clusters(rows)
    assert clusters == sorted({*map(str, range(9)), "None"})
    kernel = pairs._scan_kernel(["Silhouette"], clusters)
    sent = scan_pairs(rows, kernel, pairs.PACKED, extra=["cluster"], block_rows=75).where("kind = 'row'").count()
    assert sent <= 300 * 5
    wide = pairs.pair_indices(rows, block_rows=75).first()
    pairs_few, pairs.FEW_CLUSTERS = pairs.FEW_CLUSTERS, 0
    try:
        long = pairs.pair_indices(rows, block_rows=75).first()
    finally:
        pairs.FEW_CLUSTERS = pairs_few
    assert list(wide) == pytest.approx(list(long), rel=1e-10)


def test_scaled_squares(spark):
    from tablegauge.operators.blocks import distances, scaled_squares, sum_distances
    rng = np.random.default_rng(3)
    x = rng.normal(5, 1, (70, 24))
    y = np.vstack([rng.normal(5, 1, (60, 24)), x[:5], x[5:9] + 1e-7])
    exact = distances(x, y)
    assert np.allclose(sum_distances(x, y), exact, rtol=1e-10, atol=0)
    assert np.allclose(scaled_squares(x, y, -2.0)[0], -2.0 * exact**2, atol=1e-10)
    x[0, 0] = np.inf
    assert np.isinf(sum_distances(x, y)[0]).all() and np.isfinite(sum_distances(x, y)[1:]).all()
