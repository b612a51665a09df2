"""Distances between all rows without forming a pair of rows.

Rows are hashed into blocks, each packed into one record.  A block meets every other block
once through an equi-join on both numbers, and a small array function reduces the two blocks
to partial results inside the task, tile by tile.  Blocks grow with the table, up to
``PANEL_ROWS`` rows: what is shuffled is one copy of the table per block, never n^2 rows.
Blocks are equally large whatever the sizes of clusters or classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.session import broadcast_if_small, match_groups, spread

#: Least rows of a block, and rows of a tile: the distances held at once.
BLOCK_ROWS = TILE_ROWS = 1024
#: Rows of a tile whose distances stay in the cache between the steps of a sum.
SUM_ROWS = 512
#: Most rows of a block and bytes of its features; pairs of blocks that a core gets, if there are as many.
PANEL_ROWS, PANEL_BYTES, PAIRS_PER_CORE = 16_384, 8_000_000, 8
#: Rows of results that go back to Spark at once, or as many results.
FRAME_ROWS = 1000
#: Most tasks of a scan; beyond, a task gets several pairs.
MAX_TASKS = 20_000
#: Features from which sums of distances come from matrix products; squares below this share of the norms are too
#: inexact then, and are taken by differences.
WIDE, NEAR_SHARE = 16, 1e-4


class Block(NamedTuple):
    """Some rows of one group: ids, features (rows x d), further columns and group parameters."""

    ids: np.ndarray
    x: np.ndarray
    extra: dict[str, np.ndarray]
    params: dict[str, object]

    def part(self, at: slice) -> Block:
        return Block(self.ids[at], self.x[at], {c: v[at] for c, v in self.extra.items()}, self.params)


Kernel = Callable[[Block, Block, bool], "pd.DataFrame | Iterator[pd.DataFrame]"]


def tiles(left: Block, right: Block, same: bool, rows: int | None = None) -> Iterator[tuple[slice, slice, bool]]:
    """All pairs of tiles of two blocks; of a block and itself each unordered pair once."""
    rows = rows or TILE_ROWS
    for a in range(0, len(left.ids), rows):
        for b in range(a if same else 0, len(right.ids), rows):
            yield slice(a, a + rows), slice(b, b + rows), same and a == b


def by_tiles(kernel: Kernel) -> Kernel:
    """A kernel of blocks from one of tiles whose results need no merging inside the task."""
    def run(left: Block, right: Block, same: bool) -> Iterator[pd.DataFrame]:
        for a, b, alike in tiles(left, right, same):
            mine = left.part(a)
            yield kernel(mine, mine if alike else right.part(b), alike)
    return run


def distances(x: np.ndarray, y: np.ndarray, squared: bool = False) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` and ``y`` by differences (no cancellation)."""
    out = np.empty((len(x), len(y)))
    for start in range(0, len(x), 64):  # small tiles stay in the cache
        tile = out[start:start + 64]
        tile[:] = 0.0
        for f in range(x.shape[1]):
            diff = x[start:start + 64, f, None] - y[None, :, f]
            diff *= diff
            tile += diff
    return out if squared else np.sqrt(out, out=out)


def pair_squares(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squares of some of the :func:`distances`, equal to them in every bit."""
    out = np.zeros(len(rows))
    for f in range(x.shape[1]):
        diff = x[rows, f] - y[cols, f]
        diff *= diff
        out += diff
    return out


def rough_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by a matrix product, and a bound of their error."""
    middle = x.mean(0)
    a, b = x - middle, y - middle
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    reach = float(na.max() + nb.max())
    if not np.isfinite(reach):
        return distances(x, y, squared=True), 0.0
    out = a @ b.T
    out *= -2.0
    out += na[:, None]
    out += nb
    return np.maximum(out, 0.0, out=out), 8.0 * (x.shape[1] + 8) * np.finfo(float).eps * reach


def scaled_squares(x: np.ndarray, y: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, float]:
    """``scale`` times the squared distances by one matrix product, and the reach of the squares: nothing is added to the
    product afterwards.  Near 0 the sign may be wrong."""
    middle = x.mean(0)
    a, b = x - middle, y - middle
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    reach = float(na.max() + nb.max())
    if not np.isfinite(reach):
        return scale * distances(x, y, squared=True), reach
    return (np.hstack([-2.0 * scale * a, scale * na[:, None], np.ones((len(a), 1))])
            @ np.hstack([b, np.ones((len(b), 1)), scale * nb[:, None]]).T), reach


def sum_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of about 12 digits, for sums: near pairs, which a product cannot resolve, by differences."""
    if x.shape[1] <= WIDE:
        return distances(x, y)
    out, reach = scaled_squares(x, y)
    if np.isfinite(reach) and out.min() < NEAR_SHARE * reach:
        rows, cols = np.nonzero(out < NEAR_SHARE * reach)
        if len(rows) > out.size // 16:
            return distances(x, y)
        out[rows, cols] = pair_squares(x, y, rows, cols)
    return np.sqrt(out, out=out)


def attach_params(df: DataFrame, params: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Add per-group parameter columns: by a join, or as literals if there is one group."""
    if params is None:
        return df
    names = [c for c in params.columns if c not in by]
    if by:
        return match_groups(df, broadcast_if_small(params.select(*by, *names), 64), by)
    row = params.first()
    return df.withColumns({c: F.lit(row[c]).cast(params.schema[c].dataType) for c in names})


def _packed(df: DataFrame, keys: Sequence[str], id_col: str, features: str,
            extra: Sequence[str], prefix: str) -> DataFrame:
    rows = F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(features).alias("x"),
                                   *[F.col(c).alias(f"e_{c}") for c in extra]))
    packed = df.groupBy(*keys).agg(rows.alias("rows"))
    # A field of an array of structs is the array of that field.
    return packed.select(
        *keys, F.col("rows.id").alias(f"{prefix}_ids"), F.flatten("rows.x").alias(f"{prefix}_x"),
        *[F.col(f"rows.e_{c}").alias(f"{prefix}_e_{c}") for c in extra])


def _block(row: dict, prefix: str, extra: Sequence[str], params: dict) -> Block:
    ids = np.asarray(row[f"{prefix}_ids"])
    x = np.asarray(row[f"{prefix}_x"], dtype=float).reshape(len(ids), -1)
    return Block(ids, x, {c: np.asarray(row[f"{prefix}_e_{c}"]) for c in extra}, params)


def _run(pairs: DataFrame, by: Sequence[str], extra: Sequence[str], extra_right: Sequence[str],
         params: Sequence[str], kernel: Kernel, schema: str, same_prefix: bool) -> DataFrame:
    out_schema = T.StructType([pairs.schema[k] for k in by] + T.StructType.fromDDL(schema).fields)
    by, names = list(by), [f.name for f in out_schema.fields]

    def apply(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                values = {c: row[c] for c in params}
                left = _block(row, "l", extra, values)
                same = bool(row["same"])
                right = left if same and same_prefix else _block(row, "r", extra_right, values)
                results = kernel(left, right, same)
                for result in [results] if isinstance(results, pd.DataFrame) else results:
                    for k in by:
                        result[k] = row[k]
                    yield result[names]

    return pairs.mapInPandas(lambda batches: _gathered(apply(batches)), out_schema)


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Small frames put together: each frame that goes back to Spark has a price of its own.

    Frames of other types are kept apart, as numbers would lose digits.
    """
    kept: list[pd.DataFrame] = []
    for frame in frames:
        if kept and not frame.dtypes.equals(kept[0].dtypes):
            yield pd.concat(kept, ignore_index=True)
            kept = []
        kept.append(frame)
        if sum(map(len, kept)) >= FRAME_ROWS or len(kept) >= FRAME_ROWS:
            yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else frame
            kept = []
    if kept:
        yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]


def group_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))


def group_extent(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest)."""
    row = group_sizes(df, by).agg(F.count(F.lit(1)), F.max("_n")).first()
    return row[0], row[1] or 0


def _block_rows(df: DataFrame, features: str, pairs: float, groups: int, least: int, width: int | None = None) -> int:
    """Rows of a block: as many as leave every core its pairs of blocks, within the bounds of a block.

    ``pairs`` is the number of pairs of rows of the largest of ``groups`` groups, ``width`` that of features if known.
    """
    wanted = max(4.0, PAIRS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism / max(1, groups))
    rows = math.ceil(math.sqrt(pairs / wanted))
    if rows <= least:
        return least
    width = width or df.agg(F.max(F.size(features))).first()[0] or 1
    return max(least, min(rows, PANEL_ROWS, PANEL_BYTES // (8 * max(1, width))))


def _meet(left: DataFrame, right: DataFrame, by: Sequence[str], left_key: str, right_key: str, tasks: int) -> DataFrame:
    """Join two tables of packed blocks on the group and both block numbers.

    The optimizer takes packed and copied blocks for small rows, so a broadcast is ruled out.
    Structs compare null fields as equal, so a null group meets itself.
    """
    keys = [*(["_g"] if by else []), left_key, right_key]
    if by:
        left, right = left.withColumn("_g", F.struct(*by)), right.withColumn("_g", F.struct(*by)).drop(*by)
    return left.repartition(max(1, int(tasks)), *keys).hint("merge").join(right, keys).drop(*keys[:-2])


def scan_pairs(df: DataFrame, kernel: Kernel, schema: str, by: Sequence[str] = (),
               id_col: str = "row_id", features: str = "features", extra: Sequence[str] = (),
               params: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
               extent: tuple[int, int] | None = None) -> DataFrame:
    """Partial results of ``kernel`` over all unordered block pairs of every group.

    ``kernel(left, right, same)`` sees each pair of blocks once; ``same`` marks a block
    paired with itself.  Its columns follow ``schema``; the group columns are added.
    ``extent`` is :func:`group_extent` if it is known.
    """
    by, extra = list(by), list(extra)
    names = [] if params is None else [c for c in params.columns if c not in by]
    sizes = group_sizes(df, by)
    n_groups, largest = group_extent(df, by) if extent is None else extent
    if largest <= block_rows:
        one = _packed(spread(df, by, n_groups) if by else df, by, id_col, features, extra, "l").withColumn("same", F.lit(True))
        return _run(attach_params(one, params, by), by, extra, extra, names, kernel, schema, True)

    rows_of = _block_rows(df, features, largest * largest / 2, n_groups if by else 1, block_rows)
    blocks_of = F.ceil(F.col("_n") / rows_of).cast("int")
    if by:
        rows = match_groups(df, broadcast_if_small(sizes, len(by) + 1), by).withColumn("_blocks", blocks_of)
    else:
        rows = df.withColumn("_n", F.lit(largest)).withColumn("_blocks", blocks_of)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(id_col, F.lit("block")), F.col("_blocks")).cast("int"))
    keys = [*by, "_block", "_blocks"]
    # Parameters join one record per block, before the blocks are copied to their partners.
    left = attach_params(_packed(rows, keys, id_col, features, extra, "l"), params, by)
    # Every unordered pair once, equally many partners per block: i meets i, i+1, ..., i+B/2.
    half = F.floor(F.col("_blocks") / 2).cast("int")

    def partners(way: int, first: Callable) -> Column:
        return F.explode(F.filter(
            F.transform(F.sequence(F.lit(0), half), lambda s: F.when(
                (s * 2 != F.col("_blocks")) | (s == 0) | (first(s) < half),
                F.pmod(F.col("_block") + way * s, F.col("_blocks")))), lambda p: p.isNotNull()))

    left = left.withColumn("_partner", partners(1, lambda s: F.col("_block")))
    right = _packed(rows, keys, id_col, features, extra, "r").withColumn(
        "_left", partners(-1, lambda s: F.pmod(F.col("_block") - s, F.col("_blocks")))).drop("_blocks")
    right = right.withColumnsRenamed({"_block": "_partner", "_left": "_block"})
    # A task per pair of blocks in all groups.
    count = F.ceil(F.col("_n") / rows_of)
    blocks = -(-largest // rows_of)
    total = sizes.agg(F.sum(count * (count + 1) / 2)).first()[0] if by else blocks * (blocks + 1) // 2
    pairs = _meet(left, right, by, "_block", "_partner", min(total, MAX_TASKS))
    pairs = pairs.withColumn("same", F.col("_block") == F.col("_partner"))
    return _run(pairs, by, extra, extra, names, kernel, schema, True)


def scan_cross(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str,
               id_col: str = "row_id", features: str = "features",
               extra_left: Sequence[str] = (), extra_right: Sequence[str] = (),
               by: Sequence[str] = (), block_rows: int = BLOCK_ROWS,
               extent: tuple[int, int, int] | None = None) -> DataFrame:
    """Partial results of ``kernel`` over every block of ``left`` with every block of ``right``.

    ``by`` columns must be in both; blocks meet inside their group only.  Without them, ``extent``
    is (rows on the left, rows on the right, features) if it is known.
    """
    by = list(by)

    def groups(df: DataFrame) -> tuple[int, int]:
        n_groups, largest = group_extent(df, by)
        return max(1, n_groups), max(1, largest)

    if extent is None:
        (n_groups, n_left), (_, n_right) = groups(left), groups(right)
    else:
        n_groups, (n_left, n_right) = 1, (max(1, n) for n in extent[:2])
    rows_of = _block_rows(right, features, n_left * n_right, n_groups if by else 1, block_rows, extent and extent[2])

    def blocked(df: DataFrame, largest: int, prefix: str, extra: Sequence[str]) -> tuple[DataFrame, int]:
        count = -(-largest // rows_of)
        key = f"_{prefix}block"
        rows = df.withColumn(key, F.pmod(F.xxhash64(id_col, F.lit("block")), F.lit(count)).cast("int"))
        return _packed(rows, [*by, key], id_col, features, extra, prefix), count

    ls, left_blocks = blocked(left, n_left, "l", list(extra_left))
    rs, right_blocks = blocked(right, n_right, "r", list(extra_right))
    ls = ls.withColumn("_rblock", F.explode(F.sequence(F.lit(0), F.lit(right_blocks - 1))))
    rs = rs.withColumn("_lblock", F.explode(F.sequence(F.lit(0), F.lit(left_blocks - 1))))
    pairs = _meet(ls, rs, by, "_lblock", "_rblock", min(left_blocks * right_blocks * n_groups, MAX_TASKS))
    return _run(pairs.withColumn("same", F.lit(False)), by, list(extra_left), list(extra_right), [], kernel, schema, False)
