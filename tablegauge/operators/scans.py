"""Scans of a table that is packed as matrices: every task adds up a small matrix of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.vectors import as_vector
from tablegauge.session import materialize

#: Bytes of a block of rows, and partitions whose sums are added on the driver.
BLOCK_BYTES, FEW_PARTITIONS = 4_000_000, 16


def pack(rows: DataFrame, columns: Sequence[str] = (), features: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``rows (features, numeric columns...)`` as blocks of float matrices, written once.

    ``features`` maps a matrix of rows to the matrix that scans see.
    """
    columns = list(columns)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            step = max(1, BLOCK_BYTES // (8 * max(len(batch["features"].iloc[0]), 64)))
            for at in range(0, len(batch), step):
                part = batch.iloc[at: at + step]
                x = np.stack(part["features"].to_numpy()).astype(np.float64)
                x = features(x) if features else x
                parts = [np.ascontiguousarray(x).tobytes(), *[part[c].to_numpy().astype(np.float64).tobytes() for c in columns]]
                yield pd.DataFrame([(*parts, len(x), x.shape[1])], columns=["x", *columns, "n", "width"])

    schema = ", ".join(f"`{c}` binary" for c in ["x", *columns]) + ", n int, width int"
    return materialize(rows.select("features", *columns).mapInPandas(blocks, schema))


def matrices(batch: pd.DataFrame, columns: Sequence[str] = ()) -> Iterator[tuple[np.ndarray, ...]]:
    """The matrix and the columns of each block of a batch."""
    for x, n, width, *rest in zip(batch["x"], batch["n"], batch["width"], *[batch[c] for c in columns]):
        yield (np.frombuffer(x).reshape(n, width), *[np.frombuffer(c) for c in rest])


class Scanner:
    """Sums over all blocks of a packed table."""

    def __init__(self, blocks: DataFrame, columns: Sequence[str] = ()) -> None:
        self.blocks, self.columns = blocks, list(columns)
        self.few = blocks.select(F.spark_partition_id().alias("p")).distinct().count() <= FEW_PARTITIONS

    def sum(self, partial: Callable[..., np.ndarray]) -> np.ndarray:
        """The sum over all blocks of ``partial(matrix, columns...)``, a matrix of fixed shape.

        The sums of few tasks go to the driver; those of many are added by row first, so that the
        driver gets one matrix.
        """
        columns = self.columns

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                for parts in matrices(batch, columns):
                    part = partial(*parts)
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"slot": np.arange(len(total), dtype=np.int32), "values": list(total)})

        sums = self.blocks.mapInPandas(add, "slot int, values array<double>")
        if not self.few:
            sums = sums.groupBy("slot").agg(vector_to_array(Summarizer.sum(as_vector("values"))).alias("values"))
        found = sums.toPandas()
        if not len(found):
            raise ValueError("there are no rows")
        total = np.zeros((int(found["slot"].max()) + 1, len(found["values"].iloc[0])))
        np.add.at(total, found["slot"].to_numpy(), np.stack(found["values"].to_numpy()))
        return total
