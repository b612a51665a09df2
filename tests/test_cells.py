"""Neighbours by cells of near rows, against all pairs."""

import numpy as np
import pytest

from tablegauge.operators import cells, neighbors
from tablegauge.operators.neighbors import fold_neighbors, nearest_neighbors


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(v) for v in row], float(j % 2), j % 5) for j, (i, row) in enumerate(zip(ids, x))],
                                 "row_id bigint, features array<double>, label double, fold int")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE_SHARE", 4)
    monkeypatch.setattr(cells, "VISITORS", 50)
    monkeypatch.setattr(neighbors, "CELL_ROWS", (16, 40))
    monkeypatch.setattr(neighbors, "NEAR_ROWS", 8)
    visits = []
    inner = neighbors.visit
    monkeypatch.setattr(neighbors, "visit", lambda *a, **k: visits.append(1) or inner(*a, **k))
    return visits


def test_cells_tell_rows_apart():
    x = np.random.default_rng(1).normal(size=(500, 3))
    cut = cells.cut_cells(x, 20)
    at = cut.locate(x)
    assert len(cut.low) == 20 and np.bincount(at).max() <= 40
    assert ((cut.low[at] <= x) & (x <= cut.high[at])).all()
    assert len(cells.cut_cells(np.ones((9, 2)), 4).low) == 1


@pytest.mark.parametrize("kind", ["plain", "grid", "equal", "ids"])
def test_neighbors_by_cells_equal_all_pairs(spark, small_cells, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(420, 3)), list(range(420))
    if kind == "grid":       # many ties
        x = np.round(x)
    if kind == "equal":      # a cell that cannot be cut, and rows that are no one's neighbours
        x[:200] = 0.25
        x[300], x[301, 1] = np.nan, np.inf
    if kind == "ids":
        ids = [None if i % 50 == 0 else i // 2 for i in ids]
    rows = frame(spark, x, ids)
    train, test = rows.where("fold > 0"), rows.where("fold = 0")
    expected = found(nearest_neighbors(test, train, 4)), found(fold_neighbors(rows, 3))
    assert not small_cells
    monkeypatch.setattr(neighbors, "MANY_PAIRS", 0)
    assert found(nearest_neighbors(test, train, 4)) == expected[0]
    assert found(fold_neighbors(rows, 3)) == expected[1]
    assert len(small_cells) == 4


def test_far_tiles_do_not_meet(spark, small_cells, monkeypatch):
    x = np.random.default_rng(6).uniform(size=(2000, 2))
    rows = neighbors.Block(np.arange(2000), x, {"label": np.zeros(2000)}, {})
    met = []
    inner = neighbors.rough_squares
    monkeypatch.setattr(neighbors, "rough_squares", lambda a, b: met.append(len(a) * len(b)) or inner(a, b))
    got = neighbors._in_tiles(rows, rows, 3, "label", None, None)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(got.distance, np.sort(d, axis=1)[:, :3], rtol=1e-12)
    assert sum(met) < len(x) ** 2 / 8


def test_few_rows_and_none(spark, small_cells, monkeypatch):
    monkeypatch.setattr(neighbors, "MANY_PAIRS", 0)
    rows = frame(spark, np.random.default_rng(7).normal(size=(3, 2)))
    assert nearest_neighbors(rows, rows, 5).count() == 9
    assert nearest_neighbors(rows, rows.where("row_id < 0"), 5).count() == 0
    assert nearest_neighbors(rows.where("row_id < 0"), rows, 5).count() == 0
