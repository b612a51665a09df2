"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.session import ensure_checkpoint_dir, ship_package

#: The characters of ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: Rows of an Arrow batch: texts are long, and a Python worker holds a batch several times.
BATCH_ROWS = 1_000


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with the package on the workers, a shared folder for lineage cuts, and batches
    of few rows (unless the session's are smaller still)."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    return spark


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text`` only: no other column can clash with a helper; a null text is empty."""
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def without(column: Column, characters: str) -> Column:
    """``column`` with every one of ``characters`` deleted."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), characters, column)


def held_out(column: str | Column = "doc_id") -> Column:
    """True for the third of the ids that no model may learn from."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def pieces(frame: pd.DataFrame, columns: Iterable[str], characters: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut a batch so that the texts of one piece hold about ``characters`` characters."""
    lengths = frame[next(iter(columns))].str.len().to_numpy()
    start = total = 0
    for at, n in enumerate(lengths):
        if total and total + n > characters:
            yield frame.iloc[start:at]
            start, total = at, 0
        total += int(n)
    if start < len(lengths):
        yield frame.iloc[start:]


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``frame`` has, whatever its letters' case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
