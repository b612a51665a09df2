"""Numbered text lines: row skips, header positions and row limits for text formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.session import broadcast_if_small


def numbered_lines(spark: SparkSession, path: str, per_file: bool = False) -> DataFrame:
    """``(value, line_no)`` of the files under ``path``; 0-based over the files in path order.

    ``per_file`` numbers each file alone and adds its ``file``.

    The place of a line inside its file block comes from the reader; one counting pass
    over the blocks gives the offset of each block.  No line leaves the JVM.
    """
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("_f"),
                     F.col("_metadata.file_block_start").alias("_s"),
                     F.monotonically_increasing_id().alias("_m")))
    blocks = lines.groupBy("_f", "_s").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_f").orderBy("_s") if per_file else Window.orderBy("_f", "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # One row per file block.
    offsets = blocks.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (lines.join(broadcast_if_small(offsets, 4), ["_f", "_s"])
            .select("value", (F.col("_o") + F.col("_m") - F.col("_first")).alias("line_no"),
                    *([F.col("_f").alias("file")] if per_file else [])))


def skip_lines(lines: DataFrame, skiprows: int | Sequence[int] | None) -> DataFrame:
    """Drop the first ``skiprows`` lines, or the lines whose numbers are listed."""
    if skiprows is None:
        return lines
    if isinstance(skiprows, int):
        return lines.where(F.col("line_no") >= skiprows)
    return lines.where(~F.col("line_no").isin([int(i) for i in skiprows]))


def drop_comments(lines: DataFrame, comment: str | None) -> DataFrame:
    """Cut comments and drop the lines that are blank or only a comment."""
    if comment:
        cut = F.regexp_replace("value", f"\\Q{comment}\\E.*$", "")
        lines = lines.withColumn("value", cut)
    return lines.where(F.trim("value") != "")


def split_header(lines: DataFrame, header_row: int | None) -> tuple[str, DataFrame]:
    """(header or first line, data lines); lines before the header are dropped."""
    # Bounded: the driver sees the lines up to the header only.
    head = lines.orderBy("line_no").limit((header_row or 0) + 1).collect()
    if len(head) <= (header_row or 0):
        raise ValueError("the file ends before the header row")
    last = head[-1]
    if header_row is None:
        return last["value"], lines
    return last["value"], lines.where(F.col("line_no") > last["line_no"])


def first_lines(lines: DataFrame, nrows: int | None) -> DataFrame:
    """The first ``nrows`` data lines."""
    return lines if nrows is None else lines.orderBy("line_no").limit(nrows)
