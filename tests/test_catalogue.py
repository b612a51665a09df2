"""A sample of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry

SAMPLE = ["ext_all", "ext_phi", "int_by_group", "int_trace_wib", "sample_bags", "enc_label", "src_arff",
          "f1_knn", "report_consolidated", "metafeatures_pivot", "scale_standardize"]


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    for c in columns:
        a, b = got[c], want[c]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            assert sorted(a.astype(float).fillna(-9)) == pytest.approx(sorted(b.astype(float).fillna(-9)), abs=2e-6)
        else:
            assert sorted(map(str, a)) == sorted(map(str, b))


def test_entry(spark, sf_dir):
    rows = entry.entry(spark)
    assert rows.columns == ["index_type", "index_name", "value"] and rows.count() == 41
