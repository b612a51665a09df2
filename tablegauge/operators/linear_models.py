"""Many linear classifiers at once: every scan of the rows serves all folds and penalties.

The coefficients of all models are the columns of one matrix.  A scan multiplies blocks of rows
with it and adds up all losses and gradients; a quasi-Newton step per model follows on the
driver.  A model that needs a shorter step tries again in the next scan, beside the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.operators.scans import Scanner, matrices, pack

#: Steps remembered.
MEMORY = 8
#: A step must bring this share of what the slope promises; the smallest step tried.
ARMIJO, LEAST_STEP = 1e-4, 1e-8

COLUMNS = ("y", "w", "fold")


def pack_labelled(rows: DataFrame, weight: str, features: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``rows (features, label, fold, weight)`` packed for scans; labels become -1 and 1."""
    sign = F.when(F.col("label") > 0, 1.0).otherwise(-1.0)
    return pack(rows.select("features", sign.alias("y"), F.col(weight).cast("double").alias("w"), F.col("fold").cast("double").alias("fold")),
                COLUMNS, features)


# --- models --------------------------------------------------------------------------------


@dataclass(frozen=True)
class LinearModels:
    """Column m of ``coefficients`` and ``intercept`` m: the model of ``points[m]``, (fold left out, C)."""

    points: tuple[tuple[int, float], ...]
    coefficients: np.ndarray
    intercepts: np.ndarray
    objectives: np.ndarray
    scans: int

    def one(self, fold: int, c: float) -> tuple[np.ndarray, float]:
        m = self.points.index((fold, c))
        return self.coefficients[:, m], float(self.intercepts[m])


def logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and its slope."""
    return np.logaddexp(0.0, -margin), -1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))


def hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    short = margin < 1.0
    return np.where(short, 1.0 - margin, 0.0), np.where(short, -1.0, 0.0)


def fit_many(blocks: DataFrame, cs: Sequence[float], folds: int, loss: Callable = logistic, penalty: str = "l1",
             max_scans: int = 200, tolerance: float = 1e-5, features: Callable[[np.ndarray], np.ndarray] | None = None) -> LinearModels:
    """A model per C and fold left out (-1: none), all from the same scans.

    A model minimizes the weighted mean loss of its rows plus ``1 / (C * W)`` times the sum of
    absolute coefficients (l1) or half their squares (l2), W being the weight of its own rows: so
    C weighs the sum of losses, as usual.  Intercepts are free.  ``features`` maps the packed
    matrices in every scan, where they were packed without: narrow rows are read faster than their map.
    """
    points = tuple((fold, float(c)) for fold in range(-1, folds) for c in cs)
    left_out = np.array([fold for fold, _ in points])

    seen = features or (lambda x: x)

    def moments(x, y, w, fold):
        x = seen(x)
        by_fold = np.bincount(fold.astype(np.int64), w, minlength=folds)
        return np.stack([np.append(x.sum(0), np.append(len(x), by_fold)), np.append((x * x).sum(0), np.zeros(folds + 1))])

    scanner = Scanner(blocks, COLUMNS)
    sums = scanner.sum(moments)
    width = sums.shape[1] - folds - 1
    n, by_fold = sums[0, width], sums[0, width + 1:]
    mean = sums[0, :width] / n
    # Steps are taken on scaled columns, penalties are those of the raw ones.
    spread = np.sqrt(np.maximum(sums[1, :width] / n - mean**2, 0.0))
    scale = np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1.0), spread, 1.0)
    dead = spread <= 1e-12 * np.maximum(np.abs(mean), 1.0)
    total = np.where(left_out < 0, by_fold.sum(), by_fold.sum() - by_fold[np.maximum(left_out, 0)])
    strength = 1.0 / (np.array([c for _, c in points]) * np.maximum(total, 1e-300))
    l1 = np.zeros((width + 1, len(points)))
    l2 = l1.copy()
    if penalty == "l1":
        l1[:width] = strength[None] / scale[:, None]
    else:
        l2[:width] = strength[None] / scale[:, None] ** 2

    def values(b: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smooth objective and gradient of the active models."""
        raw = b[:width, active] / scale[:, None]
        shift = b[width, active] - mean @ raw
        out = left_out[active]

        def partial(x, y, w, fold):
            x = seen(x)
            margin = (x @ raw + shift) * y[:, None]
            cost, slope = loss(margin)
            own = w[:, None] * (fold[:, None] != out)
            slope = slope * own * y[:, None]
            return np.vstack([x.T @ slope, slope.sum(0), (cost * own).sum(0)])

        got = scanner.sum(partial) / total[active]
        gradient = np.vstack([(got[:width] - mean[:, None] * got[width]) / scale[:, None], got[width]])
        gradient[:width][dead] = 0.0
        x = b[:, active]
        return got[width + 1] + 0.5 * (l2[:, active] * x * x).sum(0), gradient + l2[:, active] * x

    b, objective, scans = _minimize(values, np.zeros((width + 1, len(points))), l1, max_scans, tolerance)
    raw = b[:width] / scale[:, None]
    return LinearModels(points, raw, b[width] - mean @ raw, objective, scans)


def _slope(x: np.ndarray, gradient: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The steepest one-sided slope of the objective with its absolute values."""
    up, down = gradient + l1, gradient - l1
    at_zero = np.where(up < 0, up, np.where(down > 0, down, 0.0))
    return np.where(x > 0, up, np.where(x < 0, down, at_zero))


def _minimize(values: Callable, x: np.ndarray, l1: np.ndarray, max_scans: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Limited-memory quasi-Newton steps for all columns of ``x``; with absolute values a step stays
    in the orthant it starts in."""
    size, m = x.shape
    steps, changes = np.zeros((MEMORY, size, m)), np.zeros((MEMORY, size, m))
    inverse = np.zeros((MEMORY, m))                       # 1 / (step . change), 0 for none
    all_ = np.arange(m)
    smooth, gradient = values(x, all_)
    objective = smooth + (l1 * np.abs(x)).sum(0)
    slope = _slope(x, gradient, l1)
    direction = _direction(slope, steps, changes, inverse)
    first = np.linalg.norm(slope, axis=0)
    length = 1.0 / np.maximum(first, 1.0)
    active, calm, scans = first > 1e-10, np.zeros(m, dtype=int), 1
    while active.any() and scans < max_scans:
        go = np.flatnonzero(active)
        start, orthant = x[:, go], np.where(x[:, go] != 0, np.sign(x[:, go]), -np.sign(slope[:, go]))
        trial = start + length[go] * direction[:, go]
        trial = np.where((l1[:, go] > 0) & (np.sign(trial) != orthant), 0.0, trial)
        smooth, new_gradient = values(_placed(x, go, trial), go)
        scans += 1
        new = smooth + (l1[:, go] * np.abs(trial)).sum(0)
        good = new <= objective[go] + ARMIJO * (slope[:, go] * (trial - start)).sum(0)
        good &= np.isfinite(new)
        # Those that gained too little try a shorter step beside the others' next ones.
        short = go[~good]
        length[short] *= 0.4
        stuck = short[length[short] < LEAST_STEP]
        active[stuck] = False
        won, at = go[good], np.flatnonzero(good)
        if not len(won):
            continue
        step, change = trial[:, at] - start[:, at], new_gradient[:, at] - gradient[:, won]
        product = (step * change).sum(0)
        useful = product > 1e-12 * (change * change).sum(0)
        kept = won[useful]
        for store, value in ((steps, step[:, useful]), (changes, change[:, useful])):
            store[:, :, kept] = np.roll(store[:, :, kept], -1, axis=0)
            store[-1][:, kept] = value
        inverse[:, kept] = np.roll(inverse[:, kept], -1, axis=0)
        inverse[-1, kept] = 1.0 / product[useful]
        gained = objective[won] - new[at]
        calm[won] = np.where(gained <= tolerance * np.maximum(np.abs(new[at]), 1e-6), calm[won] + 1, 0)
        x[:, won], gradient[:, won], objective[won] = trial[:, at], new_gradient[:, at], new[at]
        slope[:, won] = _slope(x[:, won], gradient[:, won], l1[:, won])
        direction[:, won] = _direction(slope[:, won], steps[:, :, won], changes[:, :, won], inverse[:, won])
        length[won] = 1.0
        active[won[(calm[won] >= 2) | (np.linalg.norm(slope[:, won], axis=0) <= 1e-9)]] = False
    return x, objective, scans


def _placed(x: np.ndarray, at: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = x.copy()
    out[:, at] = columns
    return out


def _direction(slope: np.ndarray, steps: np.ndarray, changes: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The quasi-Newton direction of each model, never against its slope."""
    q, shares = slope.copy(), np.zeros_like(inverse)
    for k in range(MEMORY - 1, -1, -1):
        shares[k] = inverse[k] * (steps[k] * q).sum(0)
        q -= shares[k] * changes[k]
    square = (changes[-1] ** 2).sum(0)
    q *= np.where(inverse[-1] > 0, 1.0 / np.maximum(inverse[-1] * square, 1e-300), 1.0)
    for k in range(MEMORY):
        q += steps[k] * (shares[k] - inverse[k] * (changes[k] * q).sum(0))
    return np.where(-q * slope < 0, -q, 0.0)


def fold_counts(blocks: DataFrame, models: LinearModels, features: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``cost, fold, label, prediction, n``: each row judged by the models that left its fold out; ``features`` as in
    :func:`fit_many`."""
    shared = blocks.sparkSession.sparkContext.broadcast(models)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        fold_of = np.array([f for f, _ in own.points])
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for x, y, _, fold in matrices(batch, COLUMNS):
                x = features(x) if features else x
                for f in np.unique(fold):
                    mine, which = fold == f, np.flatnonzero(fold_of == f)
                    said = x[mine] @ own.coefficients[:, which] + own.intercepts[which] > 0
                    cell = 2 * (y[mine] > 0)[:, None] + said
                    for k, m in enumerate(which):
                        total[f, m] = total.get((f, m), 0) + np.bincount(cell[:, k], minlength=4)
        rows = [(own.points[m][1], int(f), float(pair // 2), float(pair % 2), int(n[pair]))
                for (f, m), n in total.items() for pair in range(4) if n[pair]]
        yield pd.DataFrame(rows, columns=["cost", "fold", "label", "prediction", "n"]).astype(
            {"cost": "float64", "fold": "int32", "label": "float64", "prediction": "float64", "n": "int64"})

    return (blocks.mapInPandas(count, "cost double, fold int, label double, prediction double, n bigint")
            .groupBy("cost", "fold", "label", "prediction").agg(F.sum("n").alias("n")))


def predict(rows: DataFrame, coefficients: np.ndarray, intercept: float,
            features: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``rows`` with the ``prediction`` (0.0 or 1.0) of one model."""
    shared = rows.sparkSession.sparkContext.broadcast((coefficients, intercept))

    @F.pandas_udf("double")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, b = shared.value
        for series in batches:
            if not len(series):
                yield pd.Series([], dtype=float)
                continue
            x = np.stack(series.to_numpy()).astype(np.float64)
            x = features(x) if features else x
            yield pd.Series((x @ w + b > 0).astype(float))

    return rows.withColumn("prediction", said("features"))
