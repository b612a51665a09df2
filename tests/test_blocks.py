import numpy as np
import pandas as pd
import pytest
from conftest import plan_of

from tablegauge.operators import blocks, pairs
from tablegauge.operators.neighbors import nearest_neighbors
from tablegauge.operators.nearest import Least, Nearest


def points(spark, n, d=3, copies=1, seed=0):
    x = np.repeat(np.random.default_rng(seed).normal(size=(n // copies, d)), copies, axis=0)
    return x, spark.createDataFrame([(i, row.tolist(), str(i % 3), float(i % 2)) for i, row in enumerate(x)],
                                    "row_id bigint, features array<double>, cluster string, label double")


def counting():
    def one_row(left, right, same):
        return pd.DataFrame({"pairs": [len(left.ids) * (len(left.ids) - 1) // 2 if same else len(left.ids) * len(right.ids)]})
    return one_row


def test_blocks_are_never_broadcast(spark):
    """Packed and copied blocks look small to the optimizer, but hold the table many times over."""
    _, rows = points(spark, 60)
    assert "Broadcast" not in plan_of(blocks.scan_pairs(rows, counting(), "pairs bigint", block_rows=16))
    assert "Broadcast" not in plan_of(blocks.scan_cross(rows, rows, counting(), "pairs bigint", block_rows=16))
    assert "Broadcast" not in plan_of(nearest_neighbors(rows, rows, 2, block_rows=16))


@pytest.mark.parametrize("by", [(), ("cluster",)])
def test_blocks_grow_with_the_table(spark, by):
    """A row is copied to as many blocks as keep the cores busy, not to n / block_rows of them."""
    _, rows = points(spark, 600)
    found = blocks.scan_pairs(rows, counting(), "pairs bigint", by, block_rows=2).toPandas()
    assert found["pairs"].sum() == (600 * 599 // 2 if not by else 3 * 200 * 199 // 2)
    assert len(found) < 10 * blocks.PAIRS_PER_CORE * spark.sparkContext.defaultParallelism


def test_every_pair_of_a_cross_scan_once(spark):
    _, rows = points(spark, 90)
    found = blocks.scan_cross(rows.where("row_id < 70"), rows, counting(), "pairs bigint", by=["cluster"], block_rows=4).toPandas()
    assert found["pairs"].sum() == sum(len([i for i in range(70) if i % 3 == c]) * 30 for c in range(3))


@pytest.mark.parametrize("d,copies,shift", [(2, 1, 0.0), (40, 1, 0.0), (40, 7, 1e6), (40, 140, 0.0)])
def test_running_bests_equal_a_full_sort(monkeypatch, d, copies, shift):
    """Also ties, copies and far offsets, which a matrix product cannot resolve."""
    x = np.repeat(np.random.default_rng(1).normal(size=(280 // copies, d)), copies, axis=0) + shift
    ids = np.random.default_rng(2).permutation(280)
    full = blocks.distances(x, x)
    found, least = Nearest(280, 5), Least(280)
    for a in range(0, 280, 64):
        for b in range(0, 280, 64):
            at, to = slice(a, a + 64), slice(b, b + 64)
            rough, slack = blocks.rough_squares(x[at], x[to])
            assert (np.abs(rough - full[at, to] ** 2) <= slack + 1e-12 * rough).all()
            found.update(at, rough.copy(), slack, x[at], x[to], ids[to], ids[to].astype(float))
            if a == b:
                np.fill_diagonal(rough, np.inf)
            least.update(at, rough, slack, least.cost[at], lambda r, c: blocks.pair_squares(x[at], x[to], r, c),
                         lambda r, c: ids[at][r] + ids[to][c], ids[to], ids[to])
    order = np.array([np.lexsort((ids, row))[:5] for row in full])
    assert (found.id == ids[order]).all() and (found.distance == np.take_along_axis(full, order, 1)).all()
    square = blocks.distances(x, x, squared=True)
    np.fill_diagonal(square, np.inf)
    assert (least.cost == square.min(1)).all()
    assert (least.mate == [ids[np.lexsort((ids, row))[0]] for row in square]).all()


def test_wide_distances_for_sums():
    x = np.repeat(np.random.default_rng(3).normal(size=(50, 64)), 2, axis=0) + 1e3
    assert np.allclose(blocks.sum_distances(x, x), blocks.distances(x, x), rtol=1e-10, atol=0)
    assert np.allclose(pairs._steady(blocks.sum_distances(x, x)), blocks.distances(x, x), rtol=1e-10, atol=0)


def test_small_results_go_back_together():
    inner = blocks._gathered
    frames = [pd.DataFrame({"id": [2**60 + i], "v": [None]}) for i in range(2500)]
    frames.insert(1200, pd.DataFrame({"id": [np.nan], "v": [None]}))
    sent = list(inner(iter(frames)))
    assert len(sent) == 5 and sum(map(len, sent)) == 2501
    whole = [i for frame in sent for i in frame["id"].tolist()]
    assert [i for i in whole if i == i] == [2**60 + i for i in range(2500)]
    assert list(inner(iter([]))) == []
