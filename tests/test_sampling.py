import pytest
from conftest import plan_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablegauge.operators import ranking, sampling
from tablegauge.sinks import bags as bag_sink
from tablegauge.table import Table


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows in a small class, two thirds in a hot one."""
    return spark.range(1500).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("features"),
                                    (F.col("id") % 3 == 0).cast("int").alias("label")).cache()


def test_bag_plan(spark):
    assert sampling.bag_plan(1500) == (1500, 500, 24)
    assert sampling.bag_plan(900)[1:] == (450, 16) and sampling.bag_plan(1001)[1] == 500
    assert sampling.bag_plan(20, oneshot=True) == (20, 20, 1)
    with pytest.raises(ValueError):
        sampling.bag_plan(500)
    for n in (400, 900, 1500, 10 ** 6):
        row = spark.range(1).select(*sampling.bag_plan_columns(F.lit(n).cast("bigint"))).first()
        assert row["n_bags"] is None if n <= 500 else tuple(row) == sampling.bag_plan(n)


def test_sample_sizes():
    assert sampling.sample_fraction(5, 10) == sampling.sample_fraction(0.5, 10) == 0.5
    for bad in (0, 11, 1.5, 0.0, "3", True):
        with pytest.raises(ValueError):
            sampling.sample_fraction(bad, 10)


def test_bags_are_stratified_without_repeats(rows):
    bags = sampling.sample_table(rows).cache()
    sizes = bags.groupBy("bag_id", "label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("d"))
    assert {(r["label"], r["n"], r["d"]) for r in sizes.collect()} == {(0, 333, 333), (1, 167, 167)}
    assert bags.select("bag_id").distinct().count() == 24
    # Every row is drawn about 8 times, and bags differ.
    assert 1490 < bags.select("row_id").distinct().count() <= 1500
    first, second = (set(r[0] for r in bags.where(f"bag_id = {b}").select("row_id").collect()) for b in (1, 2))
    assert 100 < len(first & second) < 250


def test_large_quotas_are_drawn_in_pieces(rows, monkeypatch):
    whole = sampling.draw_bags(rows, 3, 0.5).select("bag_id", "row_id").collect()
    monkeypatch.setattr(sampling, "DRAW_CHUNK", 64)
    assert sorted(sampling.draw_bags(rows, 3, 0.5).select("bag_id", "row_id").collect()) == sorted(whole)
    assert len(set(whole)) == len(whole) == 3 * 750


def test_a_bag_of_everything(rows):
    assert sampling.draw_bags(rows, 1, 1.0).count() == 1500
    assert sampling.draw_bags(rows, 2, 1.0).count() == 3000


def test_bags_need_labels(rows):
    with pytest.raises(ValueError):
        sampling.draw_bags(rows.withColumn("label", F.when(F.col("row_id") > 0, 1)), 2, 10)


def test_draw_has_no_cartesian_product(rows):
    text = plan_of(sampling.draw_bags(rows, 24, 500))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "SortMergeJoin" in text


def test_ranks_over_many_buckets_equal_one_window(rows, monkeypatch):
    naive = rows.withColumn("pos", F.row_number().over(
        Window.partitionBy("label").orderBy(F.md5(F.concat_ws("-", F.lit("7"), "row_id")), "row_id")) - 1)
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 20)
    monkeypatch.setattr(ranking.prefix_length, "__defaults__", (20,))
    ranked = ranking.hash_rank(rows, ["label"], "row_id", 7)
    assert sorted(tuple(r) for r in ranked.select("row_id", "pos").collect()) == sorted(
        tuple(r) for r in naive.select("row_id", "pos").collect())


def test_split_and_folds(rows):
    split = sampling.stratified_split(rows)
    assert {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()} == {
        (0, True): 300, (0, False): 700, (1, True): 150, (1, False): 350}
    folds = sampling.stratified_folds(rows).groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in folds} == {(0, 200), (1, 100)} and len(folds) == 10


def test_bags_on_disk(spark, rows, tmp_path):
    bags = sampling.draw_bags(rows, 4, 30)
    path = str(tmp_path / "bags")
    bag_sink.write_bags(bags, path)
    assert bag_sink.read_bags(spark, path).count() == 120
    one = bag_sink.read_bags(spark, path, 2)
    assert one.count() == 30 and "PartitionFilters: [isnotnull(bag_id" in plan_of(one)
    with pytest.raises(Exception, match="exists"):
        bag_sink.write_bags(bags, path)


def test_bag_metadata(rows):
    row = bag_sink.bag_metadata(Table(rows, ("features",))).first()
    assert row["classes"] == {"0": 1000, "1": 500} and row["n_samples"] == 1500 and row["column_names"] == ["features"]


def test_many_classes_in_one_plan(spark):
    """A class is a row of the plan's input, not a branch of the plan."""
    rows = spark.range(16_000).select(F.col("id").alias("row_id"), (F.col("id") % 4000).cast("int").alias("label"))
    bags = sampling.draw_bags(rows, 2, 0.5)
    assert plan_of(bags).count("Union") <= 1
    per_class = bags.groupBy("bag_id", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("d"))
    assert per_class.count() == 8000 and per_class.where("n <> 2 OR d <> 2").isEmpty()
