import pytest
from pyspark.sql import functions as F

from tablegauge.operators.external import external_indices
from tablegauge.operators.internal import internal_indices
from tablegauge.session import drop_scratch, fallback_folder, match_groups, materialize


def test_local_scratch_is_refused_on_a_cluster():
    for warehouse in ("file:/tmp/warehouse", "/tmp/warehouse"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            fallback_folder("spark://host:7077", warehouse)
        assert fallback_folder("local[4]", warehouse) == f"{warehouse}/_scratch"
    assert fallback_folder("yarn", "hdfs://name/warehouse/") == "hdfs://name/warehouse/_scratch"


def test_scratch_is_removed(spark):
    table = materialize(spark.range(5))
    assert table.count() == 5
    drop_scratch(spark)
    with pytest.raises(Exception, match="exist|FileNotFound"):
        spark.read.parquet(table.inputFiles()[0]).count()


def test_null_groups_match(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "g int, x string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "g int, y int")
    assert sorted((r["x"], r["y"]) for r in match_groups(left, right, ["g"]).collect()) == [("a", 10), ("b", 20)]


@pytest.fixture(scope="module")
def grouped(spark):
    """Two equal groups, one of them under a null key."""
    rows = [(g, i, [float(i % 7), float(i * i % 11)], int(i % 3), i % 2) for g in (1, None) for i in range(60)]
    return materialize(spark.createDataFrame(rows, "g int, row_id int, features array<double>, cluster int, label int")
                       .withColumn("row_id", F.coalesce("g", F.lit(0)) * 100 + F.col("row_id")))


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_internal_indices_keep_the_null_group(grouped, block_rows):
    found = internal_indices(grouped, by=["g"], block_rows=block_rows).collect()
    values = {(r["g"], r["index_name"]): r["value"] for r in found}
    names = {n for _, n in values}
    for name in names:
        assert values[None, name] == pytest.approx(values[1, name], rel=1e-9), name


def test_external_indices_keep_the_null_group(grouped):
    found = external_indices(grouped, by=["g"], names=["Rand", "Adjusted-Mutual-Info"]).collect()
    assert len(found) == 4
