"""Every grid point of a boosting search from one pass over the rows.

Histogram trees see a row only by the bins of its features.  Rows of the same bins and label always
have the same residual, so counts and weights per cell of bins carry all that boosting needs: the rows
are read once, and every fold and grid point is boosted over cells in a task of its own.  Trees, bins
and residuals are those of the built-in learner; its candidate thresholds come from all rows here, where
it takes them from a sample of 10 000.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.session import materialize, spread

#: Bins of a feature.
MAX_BINS = 32
#: Bins of all cells of a fold that one task may hold.
CELL_LIMIT = 1 << 22
#: Histogram cells made at a time.
HISTOGRAM_CELLS = 1 << 20
#: An impurity below this is none; a gain below that share of the mean square is rounding.
NO_IMPURITY, NO_GAIN = 2.0 ** -52, 1e-14

Cuts = Mapping[int, Sequence[np.ndarray]]


def thresholds_of(values: np.ndarray, weights: np.ndarray, n_rows: int, max_bins: int = MAX_BINS) -> np.ndarray:
    """Candidate thresholds of one feature from its ascending distinct values and their weights.

    They lie halfway between neighbours: all of them if they are few, else where the weights come
    nearest to equal shares.
    """
    most = min(max_bins, n_rows) - 1
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles
    done = np.cumsum(weights)
    both, stride = done[:-1] + done[1:], done[-1] / (most + 1)
    chosen: list[int] = []
    while True:
        at = int(np.searchsorted(both, 2 * stride * (len(chosen) + 1), side="right"))
        at = max(at, chosen[-1] + 1) if chosen else at
        if at >= len(both):
            return middles[chosen]
        chosen.append(at)


def find_cuts(rows: DataFrame, folds: int) -> Cuts:
    """Fold left out (-1: none) -> thresholds per feature.  A task holds the distinct values of a feature."""
    values = rows.select("fold", "weight", F.posexplode("features").alias("feature", "value"))
    counted = values.groupBy("feature", "value", "fold").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        for fold in range(-1, folds):
            own = part[part["fold"] != fold]
            n = int(own["n"].sum())
            own = own.dropna(subset=["value"]).groupby("value", sort=True)["w"].sum()
            found.append(thresholds_of(own.index.to_numpy(dtype=np.float64), own.to_numpy(), n))
        return pd.DataFrame({"feature": part["feature"].iloc[0], "fold": np.arange(-1, folds, dtype=np.int32), "cuts": found})

    # At most 31 numbers per feature and fold.
    table = counted.groupBy("feature").applyInPandas(cut, "feature int, fold int, cuts array<double>").collect()
    by_place = {(r["fold"], r["feature"]): np.array(r["cuts"], dtype=np.float64) for r in table}
    width = 1 + max((feature for _, feature in by_place), default=-1)
    return {fold: [by_place[fold, j] for j in range(width)] for fold in range(-1, folds)}


CELLS = "left_out int, cell binary, n bigint, w0 double, w1 double, held0 bigint, held1 bigint"


def bin_cells(rows: DataFrame, cuts: Cuts) -> DataFrame:
    """Per fold left out and cell of bins: number of rows and weights by label, and the rows held out.

    ``rows`` has ``features, label, fold, weight``; rows of fold -1 are held out from every fit and
    judged by the one that leaves no fold out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(dict(cuts))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["features"].to_numpy()).astype(np.float64)
            fold, one, weight = batch["fold"].to_numpy(), batch["label"].to_numpy() > 0, batch["weight"].to_numpy()
            for left_out, own in shared.value.items():
                # From 1 on, as such strings lose zeros at their end.
                bins = np.column_stack([np.searchsorted(c, x[:, j]) + 1 for j, c in enumerate(own)]).astype(np.uint8)
                cells, at = np.unique(np.ascontiguousarray(bins).view(f"S{bins.shape[1]}").ravel(), return_inverse=True)
                held, inside = fold == left_out, (fold != left_out) & (fold >= 0)
                if not (held | inside).any():
                    continue
                sums = lambda mask, by=None: np.bincount(at, mask if by is None else mask * by, minlength=len(cells))  # noqa: B023, E731
                yield pd.DataFrame({"left_out": np.int32(left_out), "cell": list(map(bytes, cells)), "n": sums(inside).astype(np.int64),
                                    "w0": sums(inside & ~one, weight), "w1": sums(inside & one, weight),
                                    "held0": sums(held & ~one).astype(np.int64), "held1": sums(held & one).astype(np.int64)})

    counted = rows.select("features", "label", "fold", "weight").mapInPandas(count, CELLS)
    return counted.groupBy("left_out", "cell").agg(*[F.sum(c).alias(c) for c in ("n", "w0", "w1", "held0", "held1")])


# --- trees over cells ----------------------------------------------------------------------


def _impurity(w: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The variance of weighted values from their sums; 0 for none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w > 0, (q - s * s / w) / w, 0.0)


def _best_splits(bins: np.ndarray, node: np.ndarray, k: int, sums: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the gain, feature and last left bin of its best split; of equal ones the first.

    ``sums`` is (number, weight, sum, squares) by cell; ``most`` has the thresholds of each feature.
    """
    d, width = bins.shape[1], int(most.max(initial=0)) + 1
    place = (node[:, None] * d + np.arange(d)) * width + bins
    totals = np.stack([np.bincount(place.ravel(), np.repeat(s, d), minlength=k * d * width) for s in sums]).reshape(4, k, d, width)
    left = np.cumsum(totals, axis=3)
    whole = left[:, :, :, -1:]
    left, right = left[..., :-1], whole - left[..., :-1]
    parent = _impurity(*whole[1:])
    gain = parent - left[1] / whole[1] * _impurity(*left[1:]) - right[1] / whole[1] * _impurity(*right[1:])
    gain[(left[0] < 0.5) | (right[0] < 0.5) | (np.arange(width - 1) >= most[:, None])[None]] = -np.inf
    flat = gain.reshape(k, -1)
    best = flat.argmax(1)
    return flat[np.arange(k), best], best // (width - 1), best % (width - 1)


def fit_tree(bins: np.ndarray, sums: np.ndarray, depth: int, most: np.ndarray) -> np.ndarray:
    """What a regression tree of the given depth says of each cell; cells without rows go the way of their bins."""
    total = sums.sum(1)
    said = np.full(len(bins), total[2] / total[1])
    if not most.any():
        return said
    cells, node, k = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64), 1
    at_once = max(1, HISTOGRAM_CELLS // (bins.shape[1] * (int(most.max()) + 1)))
    for level in range(1, depth + 1):
        order = np.argsort(node, kind="stable")
        cells, node = cells[order], node[order]
        gain, feature, last = np.empty(k), np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        for start in range(0, k, at_once):
            stop = min(k, start + at_once)
            a, b = np.searchsorted(node, [start, stop])
            gain[start:stop], feature[start:stop], last[start:stop] = _best_splits(
                bins[cells[a:b]], node[a:b] - start, stop - start, sums[:, cells[a:b]], most)
        square = np.bincount(node, sums[3, cells], minlength=k) / np.bincount(node, sums[1, cells], minlength=k)
        goes_on = (gain > NO_GAIN * square)[node]
        cells, node = cells[goes_on], node[goes_on]
        if not len(cells):
            break
        child = 2 * node + (bins[cells, feature[node]] > last[node])
        _, child = np.unique(child, return_inverse=True)
        k = int(child.max()) + 1
        w, s, q = (np.bincount(child, x[cells], minlength=k) for x in sums[1:])
        said[cells] = (s / w)[child]
        alive = np.abs(_impurity(w, s, q)) >= NO_IMPURITY
        kept = alive[child]
        cells, node = cells[kept], (np.cumsum(alive) - 1)[child[kept]]
        k = int(alive.sum())
        if not k or level == depth:
            break
    return said


def boost(bins: np.ndarray, n: np.ndarray, w0: np.ndarray, w1: np.ndarray, rate: float, depth: int, rounds: int) -> np.ndarray:
    """The margin of each cell after boosting by logistic loss; above 0 is class 1."""
    most, margin = bins.max(0).astype(np.int64), np.zeros(len(bins))
    for turn in range(rounds):
        if turn:
            slope = np.clip(2.0 * margin, -700.0, 700.0)
            one, zero = 4.0 / (1.0 + np.exp(slope)), -4.0 / (1.0 + np.exp(-slope))
        else:
            one, zero = np.ones(len(bins)), -np.ones(len(bins))
        sums = np.stack([n, w0 + w1, w0 * zero + w1 * one, w0 * zero * zero + w1 * one * one])
        margin += (rate if turn else 1.0) * fit_tree(bins, sums, depth, most)
    return margin


def boosted_counts(cells: DataFrame, rates: Sequence[float], depths: Sequence[int], rounds: int, folds: int) -> DataFrame:
    """``rate, tree_depth, fold, label, prediction, n``: confusion counts of the rows each fit has not seen."""
    spark = cells.sparkSession
    points = spark.createDataFrame([(float(r), int(d)) for r in rates for d in depths], "rate double, tree_depth int")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        # The order of cells must not show in sums.
        part = part.sort_values("cell", ignore_index=True)
        bins = np.frombuffer(b"".join(part["cell"]), dtype=np.uint8).reshape(len(part), -1) - 1
        one = boost(bins, *[part[c].to_numpy(dtype=np.float64) for c in ("n", "w0", "w1")], part["rate"].iloc[0],
                    part["tree_depth"].iloc[0], rounds) > 0
        held = part[["held0", "held1"]].to_numpy()
        rows = [(float(label), float(said), int(held[one == said, label].sum())) for label in (0, 1) for said in (False, True)]
        found = pd.DataFrame(rows, columns=["label", "prediction", "n"])
        return found.assign(rate=part["rate"].iloc[0], tree_depth=part["tree_depth"].iloc[0], fold=part["left_out"].iloc[0]).query("n > 0")

    # One row per grid point; a fit is a task's work.
    dealt = spread(cells.crossJoin(F.broadcast(points)), ["left_out", "rate", "tree_depth"], len(rates) * len(depths) * (folds + 1))
    return dealt.groupBy("left_out", "rate", "tree_depth").applyInPandas(
        fit, "rate double, tree_depth int, fold int, label double, prediction double, n bigint")


def search_counts(train: DataFrame, test: DataFrame, weight: str, rates: Sequence[float], depths: Sequence[int], rounds: int,
                  folds: int) -> DataFrame | None:
    """:func:`boosted_counts` of all points and folds, the test rows as fold -1; None if the cells are too many for a task."""
    columns = ["features", F.col("label").cast("double").alias("label")]
    rows = train.select(*columns, "fold", F.col(weight).cast("double").alias("weight"))
    cuts = find_cuts(rows, folds)
    cells = materialize(bin_cells(rows.unionByName(test.select(*columns, F.lit(-1).alias("fold"), F.lit(0.0).alias("weight"))), cuts))
    largest = cells.groupBy("left_out").count().agg(F.max("count")).first()[0]
    if largest * len(cuts[-1]) > CELL_LIMIT:
        return None
    return materialize(boosted_counts(cells, rates, depths, rounds, folds))
