import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators.clustering import assign_nearest, cluster_groups, kmeans, long_clusters
from tablegauge.operators.clustering import fixed
from tablegauge.operators.clustering.groups import (
    ALGORITHMS, distances, forest_labels, hdbscan_labels, reachability_tree, spectral_labels, ward_labels)
from tablegauge.operators.clustering import hdbscan as hdbscan_module
from tablegauge.operators.clustering.hdbscan import core_distances, hdbscan, spanning_tree
from tablegauge.operators.clustering.links import resolve_roots, tree_components
from tablegauge.operators.clustering.spectral import spectral
from tablegauge.operators.clustering.ward import ward


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "row_id bigint, features array<double>")


def labels_of(df):
    return np.array([r["cluster"] for r in df.orderBy("row_id").collect()])


def same_partition(a, b):
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len(set(a.tolist())) == len(set(b.tolist()))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal(c, 0.4, size=(40, 2)) for c in ((0, 0), (5, 5), (0, 6))]
                     + [rng.uniform(-3, 9, size=(15, 2))])


@pytest.mark.parametrize("name", list(ALGORITHMS))
def test_kernels_find_separated_blobs(name, blobs):
    found = ALGORITHMS[name](blobs[:120], 3, 1)
    truth = np.repeat([0, 1, 2], 40)
    assert same_partition(found[found >= 0], truth[found >= 0]) and (found >= 0).mean() > 0.9


@pytest.mark.parametrize("name", list(ALGORITHMS))
def test_kernels_share_the_distances_of_a_group(name, blobs):
    square = distances(blobs, blobs, squared=True)
    kept = square.copy()
    assert (ALGORITHMS[name](blobs, 3, 1, square) == ALGORITHMS[name](blobs, 3, 1)).all()
    assert (square == kept).all()


def test_ward_merges_by_least_cost():
    x = np.array([[0.0], [1.0], [10.0], [11.5], [30.0]])
    assert same_partition(ward_labels(x, 3), np.array([0, 0, 1, 1, 2]))
    assert same_partition(ward_labels(x, 2), np.array([0, 0, 0, 0, 1]))


def test_noise_is_not_clustered():
    assert set(hdbscan_labels(np.zeros((4, 2)))) == {-1}
    line = np.arange(30, dtype=float)[:, None]
    assert set(hdbscan_labels(line)) == {-1}


def test_whole_table_ward_equals_the_kernel(spark, blobs):
    for k in (2, 5):
        got = labels_of(ward(frame(spark, blobs), k, finish=20, block_rows=40))
        assert same_partition(got, ward_labels(blobs, k))


def test_whole_table_ward_of_few_rows_needs_no_rounds(spark, blobs, monkeypatch):
    def no_round(*_):
        raise AssertionError("a round was run")

    monkeypatch.setattr("tablegauge.operators.clustering.ward._merge_round", no_round)
    assert same_partition(labels_of(ward(frame(spark, blobs), 4)), ward_labels(blobs, 4))


def test_whole_table_ward_with_repeated_ids(spark, blobs):
    rows = frame(spark, blobs)
    got = labels_of(ward(rows.unionByName(rows), 4))
    assert (got[::2] == got[1::2]).all() and same_partition(got[::2], ward_labels(blobs, 4))


def test_whole_table_ward_with_a_hot_point(spark, blobs):
    x = np.vstack([blobs, np.repeat(blobs[:1], 60, axis=0)])  # a third of all rows are one point
    got = labels_of(ward(frame(spark, x), 3, finish=20, block_rows=64))
    assert same_partition(got, ward_labels(x, 3)) and len(set(got[135:])) == 1


def test_whole_table_hdbscan_equals_the_kernel(spark, blobs):
    got = labels_of(hdbscan(frame(spark, blobs), block_rows=40))
    expected = hdbscan_labels(blobs)
    assert set(got) == set(expected) and same_partition(got, expected)


def test_spanning_tree_weight(spark, blobs):
    tree = spanning_tree(core_distances(frame(spark, blobs), 5, 64), 64)
    assert tree.count() == len(blobs) - 1
    assert tree.agg(F.sum("w")).first()[0] == pytest.approx(reachability_tree(blobs, 5)[:, 0].sum())


def test_whole_table_spectral_equals_the_kernel(spark, blobs):
    got = labels_of(spectral(frame(spark, blobs[:120]), 3, max_iter=30, block_rows=64))
    assert same_partition(got, spectral_labels(blobs[:120], 3, 1))


def test_kmeans_and_groups(spark, blobs):
    rows = frame(spark, blobs[:120])
    assert same_partition(labels_of(kmeans(rows, 3)), np.repeat([0, 1, 2], 40))
    two = rows.withColumn("label", (F.col("row_id") >= 40).cast("int")).withColumn("bag_id", F.lit(1))
    two = two.unionByName(two.withColumn("bag_id", F.lit(2)))
    wide = cluster_groups(two)
    assert wide.count() == 240
    clustered = long_clusters(wide, list(ALGORITHMS), ["bag_id", "features"])
    sizes = clustered.where("algorithm = 'hierarchical'").groupBy("bag_id", "cluster").count().collect()
    assert sorted((r["bag_id"], r["count"]) for r in sizes) == [(1, 40), (1, 80), (2, 40), (2, 80)]
    spread = clustered.where("bag_id = 1 AND algorithm = 'kmeans'").agg(F.stddev_pop(F.col("features")[0])).first()[0]
    assert spread == pytest.approx(1.0)
    for bad, error in (("nope", KeyError),):
        with pytest.raises(error):
            cluster_groups(two, [bad])
    with pytest.raises(TypeError):
        cluster_groups(two, n_clusters="many")
    with pytest.raises(ValueError):
        cluster_groups(two.drop("label"))


def test_fixed_centroids_both_ways(spark, blobs, monkeypatch):
    rows = frame(spark, blobs)
    centers = np.array([[0.0, 0], [5, 5], [0, 6]])
    given = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)],
                                  "cluster int, centroid array<double>")
    expected = distances(blobs, centers).argmin(1)
    assert (labels_of(assign_nearest(rows, given)) == expected).all()
    monkeypatch.setattr(fixed, "LITERAL_CELLS", 2)
    assert (labels_of(assign_nearest(rows, given)) == expected).all()


def test_long_chains_of_links(spark):
    links = spark.range(1, 200).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    assert {r["root"] for r in resolve_roots(links).collect()} == {0}
    edges = spark.range(1, 200).where("id != 100").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    comps = tree_components(spark.range(200).withColumnRenamed("id", "row_id"), edges)
    assert sorted(r["count"] for r in comps.groupBy("comp").count().collect()) == [100, 100]


def test_large_groups_are_clustered_as_tables(spark, monkeypatch):
    from tablegauge.operators.clustering import groups

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.2, size=(30, 2)) for c in ((0, 0), (9, 9))])
    rows = [(g, 100 * (g or 0) + i, [float(v) for v in p], i // 30) for g in (1, None) for i, p in enumerate(x)]
    rows += [(2, 1000 + i, [float(i % 2 * 9), float(i)], i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "bag_id int, row_id bigint, features array<double>, label int")
    names = ["kmeans", "hierarchical"]
    want = cluster_groups(df, names).collect()
    monkeypatch.setattr(groups, "MAX_GROUP_ROWS", 40)
    got = cluster_groups(df, names)
    assert got.columns == [*df.columns, *names]
    got = got.collect()
    for name in names:
        for bag in (1, 2, None):
            a, b = ({r["row_id"]: r[name] for r in rs if r["bag_id"] == bag} for rs in (want, got))
            assert a.keys() == b.keys() and len(a) in (20, 60)
            assert same_partition(np.array([a[i] for i in sorted(a)]), np.array([b[i] for i in sorted(a)]))


def test_starts_share_scans_and_beat_single_fits(spark, blobs):
    from pyspark.ml.clustering import KMeans
    from tablegauge.functions.vectors import as_vector
    from tablegauge.operators.clustering.kmeans import fit_kmeans

    rows = frame(spark, blobs)
    vectors = rows.select(as_vector("features").alias("features")).cache()
    for k, room in ((3, 1e-9), (5, 5e-3)):                # of three blobs there is one best partition
        fit = fit_kmeans(rows, k)
        theirs = min(KMeans(k=k, seed=s, maxIter=300).fit(vectors).summary.trainingCost for s in range(10))
        assert len(fit.costs) == 10 and fit.cost == min(fit.costs) <= theirs * (1 + room) and fit.scans < 60
    d = ((blobs[:, None] - fit.centers[None]) ** 2).sum(2)
    assert fit.cost == pytest.approx(d.min(1).sum()) and np.bincount(d.argmin(1), minlength=5).tolist() == fit.sizes.tolist()
    assert np.allclose([blobs[d.argmin(1) == c].mean(0) for c in range(5)], fit.centers, atol=1e-3)


def test_kmeans_of_odd_tables(spark):
    from tablegauge.operators.clustering.kmeans import fit_kmeans

    same = frame(spark, np.ones((7, 2)))
    assert fit_kmeans(same, 3).cost == 0 and set(labels_of(kmeans(same, 3))) == {0}
    far = frame(spark, np.array([[1e9], [1e9 + 1], [1e9 + 10], [1e9 + 11]]))
    assert same_partition(labels_of(kmeans(far, 2)), np.array([0, 0, 1, 1]))
    with pytest.raises(ValueError):
        fit_kmeans(same.limit(0), 2)


def test_groups_are_labelled_alike_on_both_sides_of_the_limit(spark, blobs, monkeypatch):
    from tablegauge.operators.clustering import groups

    rows = frame(spark, blobs[:120]).withColumn("bag_id", F.lit(1)).withColumn("label", F.lit(0)).withColumnRenamed("features", "x")
    rows = rows.withColumn("features", F.lit("a name that clashes"))
    small = cluster_groups(rows, ["kmeans", "hierarchical"], 4, features="x").orderBy("row_id").toPandas()
    monkeypatch.setattr(groups, "MAX_GROUP_ROWS", 50)
    large = cluster_groups(rows, ["kmeans", "hierarchical"], 4, features="x").orderBy("row_id").toPandas()
    assert (small["kmeans"] == large["kmeans"]).all() and set(large["features"]) == {"a name that clashes"}
    assert same_partition(small["hierarchical"].to_numpy(), large["hierarchical"].to_numpy())
    assert np.allclose(np.stack(small["x"]), np.stack(large["x"]))


def test_few_rows_look_for_edges_of_the_tree(spark, monkeypatch):
    """Ties, copies and clumps larger than the lists of nearest rows; after the first rounds few rows meet the table again."""
    rng = np.random.default_rng(3)
    grid = np.array([(i, j) for i in range(9) for j in range(9)], float)
    x = np.vstack([grid, np.zeros((30, 2)), rng.normal(40, 0.1, (60, 2)), rng.uniform(-60, 90, (60, 2))])
    asked, look = [], hdbscan_module._least_outgoing

    def counted(points, rows, asked_, extent, block_rows):
        asked.append(extent[0])
        return look(points, rows, asked_, extent, block_rows)

    monkeypatch.setattr(hdbscan_module, "_least_outgoing", counted)
    tree = spanning_tree(core_distances(frame(spark, x), 5, 64), 64).toPandas()
    expected = reachability_tree(x, 5)
    assert np.allclose(np.sort(tree["w"]), expected[:, 0], rtol=0, atol=1e-12)
    assert sorted(forest_labels(len(x), tree[["a", "b"]].to_numpy())) == [0] * len(x)
    assert sum(asked) < 2 * len(x)
