"""Silhouette, C and Dunn: the indices that look at all pairs of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.operators.blocks import (
    BLOCK_ROWS, SUM_ROWS, TILE_ROWS, WIDE, Block, distances, group_extent, scan_pairs, sum_distances, tiles)
from tablegauge.session import fold, match_groups, materialize

PAIR_INDICES = ("Silhouette", "C", "Dunn")
#: Buckets of one distance histogram, and how often a boundary bucket may be split again.
BUCKETS = 8192
MAX_SPLITS = 6
#: Distances of a boundary bucket from which it is split; fewer are listed by value.
LISTED = 3_000_000
#: Clusters of a block whose sums are held at once, and of a table whose sums are columns.
MANY_CLUSTERS, FEW_CLUSTERS = 512, 64

PARTIAL = ("kind string, id bigint, own string, other string, n bigint, total double, "
           "low double, high double")
#: Sums by row and cluster as one array: the totals, then the numbers.
PACKED = f"{PARTIAL}, sums array<double>"


def _steady(d: np.ndarray) -> np.ndarray:
    """Distances rounded to 38 binary digits: the same in every scan, whatever the order of a product's sums."""
    bits = d.view(np.int64)
    bits += 1 << 13
    bits &= -(1 << 14)
    return d


def _scan_distances(left: Block, right: Block, a: slice, b: slice, ranked: bool) -> np.ndarray:
    x, y = left.x[a], right.x[b]
    d = sum_distances(x, y)
    return _steady(d) if ranked and x.shape[1] > WIDE else d


class _Histogram:
    """Count, sum, least and greatest of the distances per bucket of [start, stop]."""

    def __init__(self, start: float, stop: float):
        self.start, self.stop = start, stop
        self.n, self.total = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS)
        self.low, self.high = np.full(BUCKETS, np.inf), np.full(BUCKETS, -np.inf)

    def add(self, d: np.ndarray) -> None:
        d = d[(d >= self.start) & (d <= self.stop)]
        if not len(d):
            return
        d = np.sort(d)
        width = (self.stop - self.start) / BUCKETS
        bucket = (np.minimum(((d - self.start) / width).astype(np.int64), BUCKETS - 1) if width > 0
                  else np.zeros(len(d), dtype=np.int64))
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[first[1:], len(d)]
        at = bucket[first]
        self.n[at] += ends - first
        self.total[at] += np.add.reduceat(d, first)
        self.low[at] = np.minimum(self.low[at], d[first])
        self.high[at] = np.maximum(self.high[at], d[ends - 1])

    def frame(self, kind: str) -> pd.DataFrame:
        at = np.flatnonzero(self.n)
        return pd.DataFrame({"kind": kind, "id": at if kind == "small" else BUCKETS - 1 - at, "own": None, "other": None,
                             "n": self.n[at], "total": self.total[at], "low": self.low[at], "high": self.high[at]})


def _row_frame(ids: np.ndarray, own: np.ndarray, names: np.ndarray, members: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
    """Per row: number and sum of its distances to the members of every cluster of the other block."""
    k = len(names)
    return pd.DataFrame({"kind": "row", "id": np.repeat(ids, k), "own": np.repeat(own, k),
                         "other": np.tile(names, len(ids)), "n": np.tile(members, len(ids)),
                         "total": sums.ravel(), "low": np.nan, "high": np.nan})


class _Listing:
    """The distances of [start, stop] by value, where they are few."""

    def __init__(self, start: float, stop: float):
        self.start, self.stop, self.found = start, stop, []

    def add(self, d: np.ndarray) -> None:
        self.found.append(d[(d >= self.start) & (d <= self.stop)])

    def frame(self, kind: str) -> pd.DataFrame:
        value, n = np.unique(np.concatenate(self.found) if self.found else np.zeros(0), return_counts=True)
        # The bits of numbers that are not negative are in their order.
        order = value.view(np.int64) if kind == "small" else -value.view(np.int64)
        return pd.DataFrame({"kind": kind, "id": order, "own": None, "other": None, "n": n, "total": value * n,
                             "low": value, "high": value})


class _RowSums:
    """Sums of the distances of a block's rows to the clusters of another block."""

    def __init__(self, here: Block, there: Block, clusters: Sequence[str] | None = None):
        self.ids, self.own = here.ids, here.extra["cluster"].astype(str)
        if clusters is None:
            self.names, self.code = np.unique(there.extra["cluster"].astype(str), return_inverse=True)
        else:
            self.names = np.array(clusters, dtype=str)
            self.code = np.searchsorted(self.names, there.extra["cluster"].astype(str))
        self.sums = np.zeros((len(here.ids), len(self.names)))

    def add(self, rows: slice, cols: slice, d: np.ndarray) -> None:
        code = self.code[cols]
        member = np.zeros((len(code), len(self.names)))
        member[np.arange(len(code)), code] = 1.0
        self.sums[rows] += d @ member

    def frame(self) -> pd.DataFrame:
        return _row_frame(self.ids, self.own, self.names, np.bincount(self.code, minlength=len(self.names)), self.sums)

    def packed(self) -> pd.DataFrame:
        """One row per row of the block instead of one per cluster."""
        members = np.bincount(self.code, minlength=len(self.names)).astype(float)
        both = np.hstack([self.sums, np.broadcast_to(members, self.sums.shape)])
        return pd.DataFrame({"kind": "row", "id": self.ids, "own": self.own, "other": None, "n": 0, "total": 0.0,
                             "low": np.nan, "high": np.nan, "sums": list(both)})


def _codes(left: Block, right: Block) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of both blocks as numbers."""
    both = np.r_[left.extra["cluster"].astype(str), right.extra["cluster"].astype(str)]
    code = np.unique(both, return_inverse=True)[1]
    return code[:len(left.ids)], code[len(left.ids):]


def _scan_kernel(names: Sequence[str], clusters: Sequence[str] | None = None) -> Callable[[Block, Block, bool], Iterator[pd.DataFrame]]:
    """Partial results for the named indices from one look at two blocks; ``clusters`` are all there are, if they are few."""
    def kernel(left: Block, right: Block, same: bool) -> Iterator[pd.DataFrame]:
        if "Silhouette" in names and clusters is None and max(len(set(block.extra["cluster"])) for block in (left, right)) > MANY_CLUSTERS:
            # Sums by cluster would be as large as the distances: tile by tile.
            if len(left.ids) > TILE_ROWS or len(right.ids) > TILE_ROWS:
                for a, b, alike in tiles(left, right, same):
                    mine = left.part(a)
                    yield from kernel(mine, mine if alike else right.part(b), alike)
                return
        own, other = _codes(left, right)
        mine, theirs = ((_RowSums(left, right, clusters), _RowSums(right, left, clusters)) if "Silhouette" in names
                        else (None, None))
        histogram = _Histogram(0.0, left.params["reach"]) if "C" in names else None
        n, total, low, high = 0, 0.0, np.inf, -np.inf
        for a, b, alike in tiles(left, right, same, SUM_ROWS):
            d = _scan_distances(left, right, a, b, "C" in names)
            if mine:
                mine.add(a, b, d)
                if not alike:
                    (mine if same else theirs).add(b, a, d.T)
            if list(names) == ["Silhouette"]:
                continue
            together = own[a][:, None] == other[b][None, :]
            if alike:
                upper = np.triu_indices(len(d), 1)
                d, together = d[upper], together[upper]
            else:
                d, together = d.ravel(), together.ravel()
            within = d[together]
            n, total = n + len(within), total + within.sum()
            if "Dunn" in names:
                low = min(low, np.where(together, np.inf, d).min(initial=np.inf))
                high = max(high, within.max(initial=-np.inf))
            if histogram:
                histogram.add(d)
        yield pd.DataFrame({"kind": ["all"], "id": 0, "own": None, "other": None, "n": n, "total": total,
                            "low": low if np.isfinite(low) else np.nan, "high": high if np.isfinite(high) else np.nan})
        if mine:
            for sums in [mine] if same else [mine, theirs]:
                yield sums.frame() if clusters is None else sums.packed()
        if histogram:
            yield histogram.frame("small")
            yield histogram.frame("large")

    def packed(left: Block, right: Block, same: bool) -> Iterator[pd.DataFrame]:
        for frame in kernel(left, right, same):
            yield frame if "sums" in frame else frame.assign(sums=None)

    return kernel if clusters is None else packed


def _split_kernel(left: Block, right: Block, same: bool) -> Iterator[pd.DataFrame]:
    """Histograms of the boundary buckets only, or what is in them if it is little."""
    p = left.params
    wanted = {side: (_Listing if p[f"{side}_n"] <= LISTED else _Histogram)(p[f"{side}_low"], p[f"{side}_high"])
              for side in ("small", "large") if p[f"{side}_low"] is not None and not np.isnan(p[f"{side}_low"])}
    for a, b, alike in tiles(left, right, same):
        d = _scan_distances(left, right, a, b, True)
        d = d[np.triu_indices(len(d), 1)] if alike else d.ravel()
        for histogram in wanted.values():
            histogram.add(d)
    for side, histogram in wanted.items():
        yield histogram.frame(side)


def _bag_values(d: np.ndarray, upper: tuple, pairs: np.ndarray, ordered: np.ndarray, cluster: np.ndarray) -> tuple:
    """(Silhouette, C, Dunn) of one clustering of a group that is one block; ``pairs`` are its distances at ``upper``."""
    names, code = np.unique(cluster.astype(str), return_inverse=True)
    size, row = np.bincount(code), np.arange(len(code))
    member = np.zeros((len(code), len(names)))
    member[row, code] = 1.0
    sums = d @ member
    a = sums[row, code] / np.maximum(size[code] - 1, 1)
    means = sums / size
    means[row, code] = np.inf
    b = means.min(1)
    top = np.maximum(a, b)
    s = np.where((size[code] > 1) & (top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1), 0.0)
    together = code[upper[0]] == code[upper[1]]
    within, apart = pairs[together], pairs[~together]
    k, several = len(within), len(names) > 1
    least, most = ordered[:k].sum(), ordered[len(ordered) - k:].sum()
    diameter = within.max() if k else 0.0
    return (s.mean() if several else None,
            (within.sum() - least) / (most - least) if most > least else None,
            0.0 if diameter <= 0 else (apart.min() / diameter if several else None))


def _bag_kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
    """The indices of all clusterings of a group: its distances are computed and sorted once."""
    d = distances(left.x, left.x)
    upper = np.triu_indices(len(left.ids), 1)
    pairs = d[upper]
    ordered = np.sort(pairs)
    found = {name: _bag_values(d, upper, pairs, ordered, cluster) for name, cluster in left.extra.items()}
    out = pd.DataFrame(list(found.values()), columns=list(PAIR_INDICES), dtype=float)
    out.insert(0, "algorithm", list(found))
    return out


def pair_indices(df: DataFrame, features: str = "features", cluster: str | Sequence[str] = "cluster",
                 by: Sequence[str] = (), row_id: str = "row_id",
                 block_rows: int = BLOCK_ROWS, names: Sequence[str] = PAIR_INDICES) -> DataFrame:
    """``(by..., Silhouette, C, Dunn)`` or the named ones of them, exact, with plain Euclidean distances.

    A row alone in its cluster scores 0 in the silhouette.  Groups that fit in one block
    are finished inside one task; larger ones go through the block scan.  Several cluster
    columns share their distances and come back as rows with an ``algorithm`` column.
    """
    by, columns = list(by), [cluster] if isinstance(cluster, str) else list(cluster)
    rows = df.select(*by, F.col(row_id).alias("row_id"), F.col(features).alias("features"),
                     *[F.col(c).cast("string").alias(c) for c in columns])
    extent = group_extent(rows, by)
    if extent[1] <= block_rows:
        found = scan_pairs(rows, _bag_kernel, "algorithm string, Silhouette double, C double, Dunn double", by,
                           extra=columns, block_rows=block_rows, extent=extent)
        keys = by if isinstance(cluster, str) else [*by, "algorithm"]
        return found.select(*keys, *[n for n in PAIR_INDICES if n in names])
    parts = [_scanned_indices(rows.withColumnRenamed(c, "cluster").select(*by, "row_id", "features", "cluster"),
                              by, block_rows, names).withColumn("algorithm", F.lit(c)) for c in columns]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.drop("algorithm") if isinstance(cluster, str) else result


def row_cluster_distances(df: DataFrame, features: str = "features", cluster: str = "cluster",
                          by: Sequence[str] = (), row_id: str = "row_id",
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(by..., row_id, cluster, n, total)``: number and sum of a row's distances to the
    members of every cluster (the row itself included, at distance 0)."""
    by = list(by)
    rows = df.select(*by, F.col(row_id).alias("row_id"), F.col(features).alias("features"),
                     F.col(cluster).cast("string").alias("cluster"))
    partial = scan_pairs(rows, _scan_kernel(["Silhouette"]), PARTIAL, by, extra=["cluster"], block_rows=block_rows)
    return (partial.where("kind = 'row'").groupBy(*by, F.col("id").alias("row_id"), F.col("other").alias("cluster"))
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def _scanned_indices(rows: DataFrame, by: list[str], block_rows: int, names: Sequence[str]) -> DataFrame:
    partial = _scan(rows, by, block_rows, names)
    makers = {"Silhouette": lambda: _silhouette(partial, by), "Dunn": lambda: _dunn(partial, by),
              "C": lambda: _c_index(rows, partial, by, block_rows)}
    parts = [makers[n]() for n in PAIR_INDICES if n in names]
    if not by:
        return fold(parts)
    result = parts[0]
    for part in parts[1:]:
        result = match_groups(result, part, by)
    return result


def _scan(rows: DataFrame, by: list[str], block_rows: int, names: Sequence[str]) -> DataFrame:
    """One pass over the block pairs; the sums are written to the checkpoint folder."""
    from tablegauge.operators.moments import global_means, to_mean

    reach = None
    if "C" in names:
        # No two rows are further apart than twice the largest distance to the mean.
        reach = (to_mean(rows, global_means(rows, by), by).groupBy(*by)
                 .agg((F.lit(2.0) * F.max("to_mean") * (1 + 1e-9)).alias("reach")))
    clusters = _few_clusters(rows) if "Silhouette" in names else None
    partial = scan_pairs(rows, _scan_kernel(names, clusters), PARTIAL if clusters is None else PACKED, by, extra=["cluster"],
                         params=reach, block_rows=block_rows)
    if clusters is None:
        return materialize(_combine(partial, by))
    return _unpacked(materialize(_combine(partial, by, 2 * len(clusters))), by, clusters)


def _few_clusters(rows: DataFrame) -> list[str] | None:
    """The clusters as blocks name them, sorted; none if they are many."""
    named = rows.select(F.coalesce("cluster", F.lit("None")).alias("c")).distinct().limit(FEW_CLUSTERS + 1).collect()
    return sorted(r["c"] for r in named) if 0 < len(named) <= FEW_CLUSTERS else None


def _unpacked(partial: DataFrame, by: list[str], clusters: Sequence[str]) -> DataFrame:
    """Sums by row and cluster as rows again."""
    k = len(clusters)
    cells = F.array(*[F.struct(F.lit(c).alias("other"), F.col(f"s{k + i}").cast("bigint").alias("n"), F.col(f"s{i}").alias("total"))
                      for i, c in enumerate(clusters)])
    columns = [*by, "kind", "id", "own", "other", "n", "total", "low", "high"]
    rows = partial.where("kind = 'row'").select(*by, "kind", "id", "own", F.inline(cells), "low", "high").where("n > 0")
    return rows.select(*columns).unionByName(partial.where("kind <> 'row'").select(*columns))


def _combine(partial: DataFrame, by: list[str], n_sums: int = 0) -> DataFrame:
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")}
    return partial.withColumns(clean).groupBy(*by, "kind", "id", "own", "other").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n_sums)])


def _silhouette(partial: DataFrame, by: list[str]) -> DataFrame:
    inside = F.col("own") == F.col("other")
    per_row = partial.where("kind = 'row'").groupBy(*by, "id").agg(
        F.max(F.when(inside, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.max(F.when(inside, F.col("n"))).alias("size"),
        F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("b").isNull(), None).when((F.col("size") == 1) | (top == 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / top)
    return per_row.groupBy(*by).agg(F.avg(s).alias("Silhouette"))


def _dunn(partial: DataFrame, by: list[str]) -> DataFrame:
    diameter = F.coalesce("high", F.lit(0.0))
    return partial.where("kind = 'all'").select(
        *by, F.when(diameter <= 0, 0.0).otherwise(F.col("low") / diameter).alias("Dunn"))


def _c_index(rows: DataFrame, partial: DataFrame, by: list[str], block_rows: int) -> DataFrame:
    """Sums of the N least and N greatest distances from histograms, split until exact."""
    within = partial.where("kind = 'all'").select(*by, F.col("n").alias("need"), F.col("total").alias("within"))
    needs = within.drop("within")
    sides = needs.select(*by, F.explode(F.array(F.lit("small"), F.lit("large"))).alias("kind"), "need")
    sums = []
    for split in range(MAX_SPLITS + 1):
        buckets = partial.where("kind in ('small', 'large')").drop("own", "other")
        joined = match_groups(buckets, sides, [*by, "kind"])
        before = Window.partitionBy(*by, "kind").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        ranked = materialize(joined.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
                             .where(F.col("seen") < F.col("need"))
                             .withColumn("rest", F.col("need") - F.col("seen"))
                             .withColumn("cut", (F.col("n") > F.col("rest")) & (F.col("low") < F.col("high"))))
        last = split == MAX_SPLITS
        done = ranked if last else ranked.where(~F.col("cut"))
        # A bucket taken in part holds equal distances (or, at the last split, almost equal ones).
        taken = F.when(F.col("n") <= F.col("rest"), F.col("total")).otherwise(
            F.col("rest") * F.col("total") / F.col("n"))
        sums.append(done.select(*by, "kind", taken.alias("taken")))
        open_ = ranked.where("cut")
        if last or open_.isEmpty():
            break
        sides = open_.select(*by, "kind", F.col("rest").alias("need"))
        params = open_.groupBy(*by).agg(*[
            F.max(F.when(F.col("kind") == side, F.col(end))).alias(f"{side}_{end}")
            for side in ("small", "large") for end in ("low", "high", "n")])
        partial = materialize(_combine(scan_pairs(rows, _split_kernel, PARTIAL, by, extra=["cluster"],
                                                  params=params, block_rows=block_rows), by))
    all_sums = sums[0]
    for part in sums[1:]:
        all_sums = all_sums.unionByName(part)
    ends = all_sums.groupBy(*by).agg(
        F.sum(F.when(F.col("kind") == "small", F.col("taken"))).alias("least"),
        F.sum(F.when(F.col("kind") == "large", F.col("taken"))).alias("most"))
    both = match_groups(within.select(*by, "within"), ends, by) if by else fold([within.select("within"), ends])
    return both.select(*by, F.try_divide(F.col("within") - F.col("least"),
                                         F.col("most") - F.col("least")).alias("C"))
