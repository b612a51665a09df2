"""Spectral clustering of a whole table.

The leading eigenvectors of the normalised RBF affinity are found by subspace iteration.
The affinity is never stored: every product with it is a block scan that recomputes the
distances of two blocks and adds up their contributions per row.  Tables whose features and vectors
are few bytes go to every task, which saves the shuffles and tables of a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.vectors import as_vector
from tablegauge.operators.blocks import BLOCK_ROWS, PANEL_BYTES, SUM_ROWS, Block, scaled_squares, scan_pairs, tiles
from tablegauge.operators.clustering.groups import RBF_GAMMA
from tablegauge.operators.clustering.kmeans import kmeans
from tablegauge.session import materialize

#: Extra vectors beyond the wanted ones speed up convergence.
OVERSAMPLE = 6
#: Most bytes of features and vectors that go to the driver and to every task.
SMALL_BYTES = PANEL_BYTES


def affinity_product(rows: DataFrame, width: int, gamma: float, block_rows: int = BLOCK_ROWS,
                     n_rows: int | None = None) -> DataFrame:
    """``(row_id, product)``: affinity (zero diagonal) times the column ``v`` of arrays.

    ``width`` is the length of ``features``; ``v`` rides along behind them.
    """
    def kernel(left: Block, right: Block, same: bool) -> pd.DataFrame:
        mine, other = (np.zeros((len(block.ids), block.x.shape[1] - width)) for block in (left, right))
        for a, b, alike in tiles(left, right, same, SUM_ROWS):
            near = scaled_squares(left.x[a, :width], right.x[b, :width], -gamma)[0]
            # No square is below 0.
            np.exp(np.minimum(near, 0.0, out=near), out=near)
            if alike:
                np.fill_diagonal(near, 0.0)
            else:
                other[b] += near.T @ left.x[a, width:]
            mine[a] += near @ right.x[b, width:]
        if same:
            return pd.DataFrame({"id": left.ids, "part": list(mine + other)})
        return pd.DataFrame({"id": np.r_[left.ids, right.ids], "part": [*mine, *other]})

    packed = rows.select("row_id", F.concat("features", "v").alias("features"))
    scanned = scan_pairs(packed, kernel, "id bigint, part array<double>", block_rows=block_rows,
                         extent=None if n_rows is None else (1, n_rows))
    return scanned.groupBy(F.col("id").alias("row_id")).agg(
        vector_to_array(Summarizer.sum(as_vector("part"))).alias("product"))


def _gram(df: DataFrame, left: str, right: str, p: int) -> np.ndarray:
    """left' right over all rows: p x p sums, added up per task and then by the vector aggregate."""
    def partial(batches):
        total = np.zeros((p, p))
        for batch in batches:
            if len(batch):
                total += np.stack(batch["l"].to_numpy()).T @ np.stack(batch["r"].to_numpy())
        yield pd.DataFrame({"part": [total.ravel()]})

    parts = df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(partial, "part array<double>")
    return parts.agg(Summarizer.sum(as_vector("part")).alias("s")).first()["s"].toArray().reshape(p, p)


def _times(column: str, matrix: np.ndarray) -> Column:
    """Row array times a small matrix."""
    @F.pandas_udf("array<double>")
    def rotate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(np.stack(x.to_numpy()) @ matrix)) if len(x) else pd.Series([], dtype=object)

    return rotate(column)


def spectral_embedding(df: DataFrame, k: int, gamma: float = RBF_GAMMA, seed: int = 42,
                       max_iter: int = 60, tol: float = 1e-5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row_id, embedding)``: k leading eigenvectors, divided by the root degrees."""
    width = df.select(F.size("features")).first()[0]
    p, n_rows = k + OVERSAMPLE, df.count()
    if 8 * n_rows * (width + 2 * p) <= SMALL_BYTES and _is_plain(df, n_rows):
        return _small_embedding(df, k, gamma, seed, max_iter, tol)
    ones = df.select("row_id", "features", F.array(F.lit(1.0)).alias("v"))
    degree = affinity_product(ones, width, gamma, block_rows, n_rows)
    root = F.when(F.col("product")[0] > 0, F.sqrt(F.col("product")[0])).otherwise(1.0)
    rows = materialize(df.select("row_id", "features").join(
        degree.select("row_id", root.alias("root")), "row_id"))
    # Start: reproducible noise per row, and the root degrees themselves (the first eigenvector).
    basis = rows.withColumn("q", F.array(F.col("root"), *_noise(seed, p - 1)))
    basis = materialize(_orthonormal(basis, "q", p))
    before = None
    for _ in range(max_iter):
        scaled = basis.select("row_id", "features", F.transform("q", lambda v: v / F.col("root")).alias("v"))
        product = affinity_product(scaled, width, gamma, block_rows, n_rows)
        moved = basis.join(product, "row_id").withColumn(
            "y", F.transform("product", lambda v: v / F.col("root"))).drop("product")
        moved = materialize(moved)
        values, vectors = np.linalg.eigh(_gram(moved, "q", "y", p))
        turn = vectors[:, ::-1]
        leading = values[::-1][:k]
        done = before is not None and np.abs(leading - before).max() < tol
        before = leading
        if done:
            break
        # (M + I) / 2 has the same eigenvectors and no negative eigenvalues.
        shifted = moved.withColumn("q", F.zip_with("q", "y", lambda a, b: (a + b) / 2)).drop("y")
        basis = materialize(_orthonormal(shifted, "q", p))
    ritz = moved.select("row_id", "root", _times("q", turn[:, :k]).alias("u"))
    return ritz.select("row_id", F.transform("u", lambda v: v / F.col("root")).alias("embedding"))


def _noise(seed: int, n: int) -> list[Column]:
    return [F.xxhash64("row_id", F.lit(f"{seed}-{j}")) / F.lit(2.0 ** 63) for j in range(n)]


def _turn_to_orthonormal(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    return vectors / np.sqrt(np.maximum(values, values.max() * 1e-14))


def _orthonormal(df: DataFrame, column: str, p: int) -> DataFrame:
    """Orthonormal columns from the p x p Gram matrix."""
    return df.withColumn(column, _times(column, _turn_to_orthonormal(_gram(df, column, column, p))))


# --- tables that fit a task --------------------------------------------------------------------


def _is_plain(df: DataFrame, n_rows: int) -> bool:
    """Has every row an id of its own and as many features, none of them null?"""
    odd = F.col("row_id").isNull() | F.col("features").isNull() | F.coalesce(F.exists("features", lambda v: v.isNull()), F.lit(True))
    found = df.agg(F.count_if(odd).alias("odd"), F.count_distinct("row_id").alias("ids"), F.min(F.size("features")).alias("lo"),
                   F.max(F.size("features")).alias("hi")).first()
    return not found["odd"] and found["ids"] == n_rows and found["lo"] == found["hi"] > 0


def _small_embedding(df: DataFrame, k: int, gamma: float, seed: int, max_iter: int, tol: float) -> DataFrame:
    """:func:`spectral_embedding` by the same steps; a round is one job, whose tasks multiply some rows of the affinity each."""
    spark = df.sparkSession
    p = k + OVERSAMPLE
    # At most SMALL_BYTES.
    rows = df.select("row_id", "features", F.array(*_noise(seed, p - 1)).alias("noise")).orderBy("row_id").collect()
    x, n = np.array([r["features"] for r in rows], dtype=np.float64), len(rows)
    shared = spark.sparkContext.broadcast(x)
    starts = spark.range(0, n, SUM_ROWS, max(1, min(-(-n // SUM_ROWS), spark.sparkContext.defaultParallelism)))

    def product(v: np.ndarray) -> np.ndarray:
        """Affinity (zero diagonal) times ``v``."""
        vectors = spark.sparkContext.broadcast(v)

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            points, v_ = shared.value, vectors.value
            for batch in batches:
                for start in batch["id"]:
                    a = points[start:start + SUM_ROWS]
                    total = np.zeros((len(a), v_.shape[1]))
                    for other in range(0, len(points), SUM_ROWS):
                        near = scaled_squares(a, points[other:other + SUM_ROWS], -gamma)[0]
                        np.exp(np.minimum(near, 0.0, out=near), out=near)
                        if other == start:
                            np.fill_diagonal(near, 0.0)
                        total += near @ v_[other:other + SUM_ROWS]
                    yield pd.DataFrame({"start": [start], "part": [total.tobytes()]})

        found = starts.mapInPandas(multiply, "start bigint, part binary").collect()
        vectors.destroy()
        parts = [np.frombuffer(r["part"]).reshape(-1, v.shape[1]) for r in sorted(found, key=lambda r: r["start"])]
        return np.concatenate(parts)

    degree = product(np.ones((n, 1)))
    root = np.sqrt(np.where(degree > 0, degree, 1.0))
    q = np.column_stack([root, np.array([r["noise"] for r in rows], dtype=np.float64).reshape(n, p - 1)])
    q = q @ _turn_to_orthonormal(q.T @ q)
    before = None
    for _ in range(max_iter):
        y = product(q / root) / root
        values, vectors = np.linalg.eigh(q.T @ y)
        leading = values[::-1][:k]
        done = before is not None and np.abs(leading - before).max() < tol
        before, turn, u = leading, vectors[:, ::-1][:, :k], q
        if done:
            break
        q = (q + y) / 2
        q = q @ _turn_to_orthonormal(q.T @ q)
    shared.destroy()
    embedding = (u @ turn / root).tolist()
    return spark.createDataFrame([(r["row_id"], e) for r, e in zip(rows, embedding)],
                                 f"row_id {df.schema['row_id'].dataType.simpleString()}, embedding array<double>")


def spectral(df: DataFrame, k: int, gamma: float = RBF_GAMMA, row_id: str = "row_id",
             features: str = "features", seed: int = 42, max_iter: int = 60,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``cluster``: k-means on the spectral embedding."""
    rows = materialize(df.select(F.col(row_id).alias("row_id"), F.col(features).alias("features")))
    embedding = materialize(spectral_embedding(rows, k, gamma, seed, max_iter, block_rows=block_rows))
    labelled = kmeans(embedding, k, features="embedding", seed=seed)
    return df.join(labelled.select(F.col("row_id").alias(row_id), "cluster"), row_id)
