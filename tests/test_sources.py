import pytest
from pyspark.sql import functions as F

from tablegauge.operators.encoding import dummy_code_table
from tablegauge.sources import arff, csv, dispatch, libsvm, memory
from tablegauge.sources.lines import numbered_lines


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


SHELLS = """Shells of a beach
measured by hand

the header follows
Sex, Length, Height, Weight, Rings
M, 0.45, 0.09, 0.5, 15
F, 0.53, 0.13, 0.6, 9
I, 0.33, 0.08, 0.2, 7
F, 0.55, 0.15, 0.9, 20
I, 0.42, 0.10, 0.3, 8
M, 0.44, 0.12, 0.5, 10
F, 0.50, 0.14, 0.7, 19
M, 0.35, 0.09, 0.2, 7
F, 0.52, 0.13, 0.6, 16
"""


def test_csv_with_skips_header_and_projection(spark, tmp_path):
    table = csv.read_csv(spark, write(tmp_path, "shells.csv", SHELLS), skiprows=4, header_row=0,
                         usecols=["Sex", "Length", "Height", "Rings"], target_col=-1, encode_target=False)
    rows = table.df.select("Sex", "Length", "Height", "label").collect()
    assert table.features == ("Sex", "Length", "Height") and table.nominal == ("Sex",)
    assert [r["Sex"] for r in sorted(rows, key=lambda r: (r["label"], r["Length"]))] == [1, 2, 1, 0, 2, 2, 0, 0, 0]
    assert sorted(r["label"] for r in rows) == [7, 7, 8, 9, 10, 15, 16, 19, 20]
    codes = {r["category"]: r["code"] for r in table.categories.collect()}
    assert codes == {"F": 0, "I": 1, "M": 2}


def test_csv_whitespace_drops_wide_text(spark, tmp_path):
    text = "".join(f"id{i}  {'ep'[i % 2]}   {'xyz'[i % 3]} \t {i}\n" for i in range(12))
    table = csv.read_csv(spark, write(tmp_path, "plants.csv", text), sep=csv.WHITESPACE, target_col=1)
    assert table.features == ("c2", "c3") and table.nominal == ("c2",)
    assert sorted(r["label"] for r in table.df.collect()) == [0] * 6 + [1] * 6


def test_csv_missing_values(spark, tmp_path):
    path = write(tmp_path, "gaps.csv", "1,2,a\n,3,b\n4,NA,a\n5,?,b\n6,7,\n8,9,b\n")
    table = csv.read_csv(spark, path, na_values="?")
    assert sorted((r["c0"], r["c1"], r["label"]) for r in table.df.collect()) == [(1, 2, 0), (8, 9, 1)]
    per_column = csv.read_csv(spark, path, na_values={1: ["2", "?"]})
    assert [r["c0"] for r in per_column.df.collect()] == [8]


def test_csv_listed_skips_limits_and_comments(spark, tmp_path):
    path = write(tmp_path, "odd.csv", "% a comment\nx;y\n1;2\nskip;me\n3;4 % tail\n\n5;6\n")
    rows = csv.read_csv_columns(spark, path, sep=";", skiprows=[3], header_row=0, comment="%")
    assert [(r["x"], r["y"].strip()) for r in rows.collect()] == [("1", "2"), ("3", "4"), ("5", "6")]
    first = csv.read_csv_columns(spark, path, sep=";", skiprows=[3], header_row=0, comment="%", nrows=2)
    assert sorted(r["x"] for r in first.collect()) == ["1", "3"]


def test_csv_number_target_and_no_target(spark, tmp_path):
    path = write(tmp_path, "t.csv", "10,a\n2,b\n10,a\n3,b\n7,a\n")
    table = csv.read_csv(spark, path, target_col=0)
    assert {r["category"]: r["code"] for r in table.categories.where("column = 'label'").collect()} == {
        "2.0": 0, "3.0": 1, "7.0": 2, "10.0": 3}
    assert csv.read_csv(spark, path, target_col=None).label is None


def test_numbered_lines_span_blocks(spark, tmp_path):
    path = write(tmp_path, "long.txt", "".join(f"line {i}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = numbered_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 2
        assert lines.where(F.concat(F.lit("line "), F.col("line_no")) != F.col("value")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_libsvm(spark, tmp_path):
    path = write(tmp_path, "b.libsvm", "2.0 1:10 3:1.5\n4.0 2:7\n2.0 1:1 2:2 3:3\n")
    table = libsvm.read_libsvm(spark, path)
    assert table.features == ("f1", "f2", "f3")
    assert sorted(tuple(r) for r in table.df.collect()) == [(0, 7, 0, 1), (1, 2, 3, 0), (10, 0, 1.5, 0)]
    raw = libsvm.read_libsvm(spark, path, type="regression", n_features=4)
    assert len(raw.features) == 4 and sorted(r["label"] for r in raw.df.collect()) == [2, 2, 4]
    with pytest.raises(NotImplementedError):
        libsvm.read_libsvm(spark, path, type="ranking")


ARFF = """% patients
@relation ward

@attribute Age integer
@attribute Sex {male, female}
@attribute Drug {no, yes}
@attribute Albumin real
@attribute Class {DIE, LIVE}

@data
30,male,no,4,LIVE
50,female,no,3.5,LIVE
31,female,?,4,LIVE
46,female,yes,3.3,DIE
53,male,no,4.1,LIVE
"""


def test_arff(spark, tmp_path):
    path = write(tmp_path, "ward.arff", ARFF)
    table = arff.read_arff(spark, path, target_attr="Class")
    assert table.nominal == ("Sex", "Drug")
    rows = sorted(tuple(r) for r in table.df.select(*table.features, "label").collect())
    assert rows == [(30, 1, 0, 4, 1), (46, 0, 1, 3.3, 0), (50, 0, 0, 3.5, 1), (53, 1, 0, 4.1, 1)]
    assert arff.read_arff(spark, path, target_attr="Class", drop_na_rows=False).df.count() == 5
    ages = arff.read_arff(spark, path, target_attr="Class", numeric_categorical_attrs=["Age"])
    assert sorted(r["Age"] for r in ages.df.collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        arff.read_arff(spark, path)


def test_dispatch_and_dummy_columns(spark, tmp_path):
    path = write(tmp_path, "cars.csv", "".join(f"{i % 2},{'abc'[i % 3]},{i}\n" for i in range(12)))
    table = dispatch.read_dataset(spark, path, target_col=0)
    assert table.features == ("c2", "c1_0", "c1_1", "c1_2")
    assert table.df.agg(F.sum("c1_0"), F.sum("c1_2")).first()[:] == (4, 4)
    dropped = dummy_code_table(csv.read_csv(spark, path, target_col=0), drop_first=True)
    assert dropped.features == ("c2", "c1_1", "c1_2")
    for bad in ("cars.txt", "cars"):
        with pytest.raises(ValueError):
            dispatch.read_dataset(spark, bad)


def test_nested_features(spark):
    rows = spark.createDataFrame([([[[1.0], [2.0]], [[3.0, 4.0], [5.0, 6.0]]], 0), ([[[7.0]], [[9.0] * 5]], 1)],
                                 "features array<array<array<double>>>, y int")
    flat = memory.load_data(rows, label="y").orderBy("label").collect()
    assert flat[0]["features"] == [1, 2, 3, 4, 5, 6] and len(flat[1]["features"]) == 6
    with pytest.raises(ValueError):
        memory.load_data(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>"))
    assert memory.is_class_label(rows.withColumn("label", F.lit(1)))


def test_ragged_rows_fail(spark, tmp_path):
    from tablegauge.sources import csv

    (tmp_path / "r.csv").write_text("1,2,y\n1,2,3,n\n4,5,n\n")
    (tmp_path / "s.csv").write_text("1,2,y\n1,2\n")
    (tmp_path / "t.csv").write_text("1 2 y\n1 2 3 n\n")
    for name, options in (("r", {}), ("s", {}), ("r", {"nrows": 3}), ("t", {"sep": r"\s+"})):
        with pytest.raises(Exception, match="malformed row"):
            csv.read_csv_columns(spark, str(tmp_path / f"{name}.csv"), **options).collect()


def test_arff_rows_may_start_with_a_sign(spark, tmp_path):
    from tablegauge.sources import arff

    head = "@relation r\n@attribute name string\n".replace("name string", "name {@b,c}") + "@attribute size real\n@attribute class {p,q}\n@data\n"
    (tmp_path / "a.arff").write_text(head + "% note\n@b,2,p\nc,?,q\n")
    (tmp_path / "b.arff").write_text(head + "c,7,q\n")
    rows, attributes = arff.read_arff_columns(spark, str(tmp_path))
    assert len(attributes) == 3
    assert sorted((r["name"], r["size"]) for r in rows.collect() if r["size"]) == [("@b", 2.0), ("c", 7.0)]
    (tmp_path / "bad.arff").write_text(head + "c,oops,q\n")
    with pytest.raises(Exception, match="malformed row"):
        arff.read_arff_columns(spark, str(tmp_path / "bad.arff"))[0].collect()
