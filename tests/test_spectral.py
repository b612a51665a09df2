"""Spectral clustering of small tables, beside the block scans."""

import numpy as np
from pyspark.sql import functions as F

from tablegauge.operators.clustering import spectral as module


def frame(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.4, (30, 3)) for c in (0.0, 1.2, 2.6)])
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")


def embedded(rows):
    found = module.spectral_embedding(rows, 3, max_iter=4, block_rows=32).orderBy("row_id").collect()
    return [r["row_id"] for r in found], np.array([r["embedding"] for r in found])


def test_small_tables_need_no_block_scans(spark, monkeypatch):
    rows = frame(spark)
    monkeypatch.setattr(module, "SMALL_BYTES", 0)
    ids, scanned = embedded(rows)
    monkeypatch.setattr(module, "SMALL_BYTES", 1 << 20)
    monkeypatch.setattr(module, "SUM_ROWS", 32)
    monkeypatch.setattr(module, "scan_pairs", None)  # would fail
    same, small = embedded(rows)
    assert ids == same == list(range(90))
    # Eigenvectors may be turned round.
    assert np.allclose(small * np.sign((small * scanned).sum(0)), scanned, atol=1e-8)


def test_odd_rows_go_through_the_scans(spark):
    rows = frame(spark)
    assert module._is_plain(rows, 90)
    assert not module._is_plain(rows.unionByName(rows.limit(1)), 91)
    assert not module._is_plain(rows.withColumn("row_id", F.nullif("row_id", F.lit(3))), 90)
    assert not module._is_plain(rows.withColumn("features", F.when(F.col("row_id") > 3, F.array(F.lit(None).cast("double"))).otherwise(F.col("features"))), 90)
