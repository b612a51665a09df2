"""Dense ranks without one-task windows.

``row_number() over (partition by class)`` sends a class to one task.  The ranks here
split every group into hash buckets (the leading hex digits of an md5), rank inside the
buckets and add the bucket offsets.  The result depends on the data only, not on the
partitioning, so a lost executor recomputes the same ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.session import broadcast_if_small, materialize

#: Rows a bucket should hold on average.
BUCKET_ROWS = 50_000


def hash_order(seed: int | str, row_id: Column | str) -> Column:
    """The md5 text that shuffles rows: equal in any engine with an md5 function."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat_ws("-", F.lit(str(seed)), row_id.cast("string")))


def prefix_length(n_rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits needed to keep buckets near ``bucket_rows`` rows."""
    if n_rows <= bucket_rows:
        return 0
    return math.ceil(math.log(n_rows / bucket_rows, 16))


def hash_rank(df: DataFrame, group: Sequence[str], row_id: str, seed: int | str,
              n_rows: int | None = None, out: str = "pos") -> DataFrame:
    """Add ``out``: 0-based rank of each row of its ``group`` in hash order.

    ``row_id`` must be unique within a group.  ``n_rows`` (the size of the largest
    group, or of the table) only sets the bucket count.
    """
    group = list(group)
    if n_rows is None:
        n_rows = df.count()
    digits = prefix_length(n_rows)
    keyed = df.withColumn("_h", hash_order(seed, row_id))
    if digits == 0:
        window = Window.partitionBy(*group).orderBy("_h", row_id)
        return keyed.withColumn(out, (F.row_number().over(window) - 1).cast("bigint")).drop("_h")
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    counts = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", row_id)
    ranked = keyed.withColumn("_r", F.row_number().over(inside) - 1)
    return (ranked.join(broadcast_if_small(offsets, len(group) + 2), [*group, "_b"])
            .withColumn(out, (F.col("_o") + F.col("_r")).cast("bigint"))
            .drop("_h", "_b", "_o", "_r"))


def number_rows(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Add unique BIGINT ids and fix them by writing the rows to the checkpoint folder."""
    return materialize(df.withColumn(out, F.monotonically_increasing_id()))


def global_rank(df: DataFrame, order: Sequence[str], out: str = "code") -> DataFrame:
    """Add the 0-based rank of every row in a total order, by range partitions and offsets."""
    rows = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_m"), 33)
    in_part = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: a window over a few thousand rows.
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return (rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
            .withColumn(out, (F.col("_o") + in_part).cast("bigint")).drop("_p", "_m", "_o"))
