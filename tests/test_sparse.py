"""Sparse rows against dense ones, and sizes beyond any list of columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablegauge.operators import encoding
from tablegauge.operators.sparse import read_libsvm_sparse, sparse_dummies
from tablegauge.table import Table


@pytest.fixture(scope="module")
def encoded(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.normal(4, 2)), str(rng.choice(["red", "green", "blue"])), f"v{rng.integers(0, 9)}", int(i % 2)) for i in range(80)]
    raw = Table(spark.createDataFrame(rows, "id long, size double, colour string, kind string, label int").cache(), ("size", "colour", "kind"))
    return encoding.encode(raw, ["colour", "kind"])


@pytest.mark.parametrize("drop_first", [False, True])
def test_sparse_rows_equal_dense_dummies(encoded, drop_first):
    sparse = sparse_dummies(encoded, drop_first, "id")
    dense = encoding.dummy_code_table(encoded, drop_first=drop_first)
    names = {r["position"]: (r["column"], r["value"]) for r in sparse.positions.collect()}
    assert sorted(names) == list(range(sparse.width)) and sparse.width == len(dense.features)
    codes = {(r["column"], r["category"]): r["code"] for r in encoded.categories.collect()}
    got = {r["row_id"]: r["v"] for r in sparse.rows.select("row_id", vector_to_array("features").alias("v")).collect()}
    for r in dense.df.collect():
        for p, (column, value) in names.items():
            assert got[r["id"]][p] == (r[column] if value is None else r[f"{column}_{codes[column, value]}"])
    assert set(sparse.rows.columns) == {"row_id", "label", "features"}


def test_moments_and_scaling(encoded):
    sparse = sparse_dummies(encoded, row_id="id")
    x = np.stack([r[0] for r in sparse.rows.orderBy("row_id").select(vector_to_array("features")).collect()])
    for r in sparse.moments().collect():
        p = r["position"]
        assert (r["n"], r["non_zeros"]) == (80, (x[:, p] != 0).sum())
        assert r["mean"] == pytest.approx(x[:, p].mean()) and r["std"] == pytest.approx(x[:, p].std())
    scaled = np.stack([r[0] for r in sparse.scaled().rows.orderBy("row_id").select(vector_to_array("features")).collect()])
    assert np.allclose(scaled, x / x.std(0))
    by_label = sparse.moments(["label"]).collect()
    assert len(by_label) == 2 * sparse.width


def test_more_categories_than_columns_fit(spark):
    """7 000 categories: refused as columns, rows of a dimension here."""
    rows = spark.range(7000).select(F.col("id"), F.format_string("c%05d", "id").alias("name"), (F.col("id") % 2).alias("label"))
    table = encoding.encode(Table(rows, ("name",)), ["name"])
    with pytest.raises(ValueError, match="sparse_dummies"):
        encoding.dummy_code_table(table)
    sparse = sparse_dummies(table, row_id="id")
    assert sparse.width == 7000 and sparse.positions.count() == 7000
    some = sparse.rows.where("row_id = 6123").first()["features"]
    assert some.size == 7000 and some.indices.tolist() == [6123] and some.values.tolist() == [1.0]
    assert sparse.moments().agg(F.sum("non_zeros")).first()[0] == 7000


def test_libsvm_of_a_million_features(spark, tmp_path):
    (tmp_path / "wide.txt").write_text("1 3:0.5 1000000:2\n0 1:4\n1 7:1 8:2 9:3\n")
    sparse = read_libsvm_sparse(spark, str(tmp_path / "wide.txt"))
    assert sparse.width == 1_000_000 and sparse.positions.count() == 1_000_000 and len(sparse.rows.columns) == 3
    found = sorted((r["label"], r["features"].indices.tolist()) for r in sparse.rows.collect())
    assert found == [(0.0, [0]), (1.0, [2, 999_999]), (1.0, [6, 7, 8])]
    assert sparse.positions.where("position = 999999").first()["column"] == "f1000000"


def test_categories_without_rows_keep_their_positions(encoded):
    kept = Table(encoded.df.where("colour = 0"), encoded.features, "label", encoded.nominal, encoded.categories)
    sparse = sparse_dummies(kept, row_id="id")
    assert sparse.rows.first()["features"].size == sparse.width == 13
