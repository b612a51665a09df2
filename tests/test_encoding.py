import pytest
from pyspark.sql import functions as F

from tablegauge.functions.numbers import log_gamma, next_prime, nominal_limit, nominal_limit_column
from tablegauge.operators import classes, cleaning, encoding, scaling
from tablegauge.table import Table


def test_nominal_limit(spark):
    assert [nominal_limit(n) for n in (3, 16, 17, 60, 1500, 200_000)] == [1, 6, 5, 15, 27, 2000]
    for n in (1, 16, 17, 60, 1500, 99_999, 200_001):
        assert spark.range(1).select(nominal_limit_column(F.lit(n))).first()[0] == nominal_limit(n)


def test_log_gamma(spark):
    import math
    for x in (1.0, 2.0, 5.5, 1e3, 1e9):
        got = spark.range(1).select(log_gamma(F.lit(x))).first()[0]
        assert got == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)


def test_next_prime():
    assert [next_prime(n) for n in (1, 2, 14, 23, 10 ** 9)] == [2, 2, 17, 23, 1000000007]


def test_codes_rank_values(spark):
    df = spark.createDataFrame([(10, "b"), (2, "a"), (10, None)], "n int, s string")
    coded, dimension = encoding.label_encode(df, ["n", "s"])
    assert sorted((r["n"], r["s"]) for r in coded.collect() if r["s"] is not None) == [(0, 0), (1, 1)]
    assert {(r["column"], r["category"]): r["code"] for r in dimension.collect()} == {
        ("n", "2"): 0, ("n", "10"): 1, ("s", "a"): 0, ("s", "b"): 1}
    with pytest.warns(UserWarning):
        encoding.label_encode(df, ["missing"])


def test_codes_are_ranks_of_sorted_values(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("v"))
    values = encoding.distinct_values(df, ["v"])

    def codes():
        rows = encoding.category_codes(values, "v", df.schema["v"].dataType).collect()
        return {r["value"]: r["code"] for r in rows}

    found = codes()
    assert found == {v: i for i, v in enumerate(sorted(found))}


def test_infer_nominal(spark):
    df = spark.range(100).select(F.concat(F.lit("x"), F.col("id")).alias("wide"),
                                 F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("narrow"), "id")
    assert encoding.infer_nominal(df, df.columns) == (["narrow"], ["wide"])
    table = encoding.encode(Table(df, tuple(df.columns), None))
    assert table.features == ("narrow", "id")
    with pytest.raises(TypeError):
        encoding.encode(Table(df, ("id",), None), categorical=3.5)


def test_dummies(spark):
    df = spark.createDataFrame([(1, 2.0), (10, 3.0), (2, 4.0)], "code int, x double")
    assert encoding.dummy_code(df, ["code"]).columns == ["x", "code_1", "code_2", "code_10"]
    assert encoding.dummy_code(df, ["code"], drop_first=True).columns == ["x", "code_2", "code_10"]
    with pytest.warns(UserWarning):
        assert encoding.dummy_code(df, ["nope"]).columns == df.columns
    hot = encoding.dummy_vector(df, ["code"]).select("dummies").first()[0]
    assert hot.size == 11 and hot.numNonzeros() == 1


def test_scaling_round_trip(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "a"), (8.0, 5.0, "b")], "x double, c double, g string")
    stats = scaling.scale_stats(df, ["x", "c"])
    scaled = scaling.standardize(df, ["x", "c"], stats=stats)
    assert scaled.agg(F.round(F.avg("x"), 12), F.round(F.stddev_pop("x"), 12), F.max("c")).first()[:] == (0, 1, 0)
    back = scaling.destandardize(scaled, ["x", "c"], stats)
    assert sorted(round(r["x"], 9) for r in back.collect()) == [1, 3, 8]
    groups = scaling.standardize(df, ["x"], by=["g"])
    assert sorted(r["x"] for r in groups.collect()) == [-1, 0, 1]
    arrays = scaling.standardize_array(df.select(F.array("x", "c").alias("features"), "g"))
    assert sorted(r["features"][0] for r in arrays.collect()) == pytest.approx(sorted(r["x"] for r in scaled.collect()))
    with pytest.raises(ValueError):
        scaling.scale_stats(df, ["g"])


def test_class_roles(spark):
    tied = spark.createDataFrame([("b",), ("a",)], "label string")
    row = classes.class_roles(tied).first()
    assert (row["majority"], row["minority"], row["imbalance_ratio"]) == ("a", "b", 1.0)
    rows = spark.createDataFrame([(1,), (1,), (1,), (0,)], "label int")
    assert sorted(r["weight"] for r in classes.balanced_weights(rows).collect()) == [1, 1, 1, 3]
    for bad in ([(1,)], [(1,), (2,), (3,)]):
        with pytest.raises(ValueError):
            classes.check_binary(spark.createDataFrame(bad, "label int"))


def test_cleaning(spark):
    df = spark.createDataFrame([("1", "x"), ("NA", "y"), ("two", " null ")], "a string, b string")
    clean = cleaning.na_to_null(df, {"b": ["y"]})
    assert [tuple(r) for r in clean.collect()] == [("1", "x"), (None, None), ("two", None)]
    assert {r["column"]: r["n_text"] for r in cleaning.cast_report(clean, ["a", "b"]).collect()} == {"a": 1, "b": 1}
    assert cleaning.cast_numeric(clean, ["a"]).where("a is null").count() == 2
    with pytest.raises(ValueError):
        cleaning.project(df, ["z"])
    assert cleaning.project(df, [1]).columns == ["b"]
    assert cleaning.split_target(df, None)[1] == ["a", "b"]
