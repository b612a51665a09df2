"""Z-scores with the population deviation, and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.vectors import as_vector


def scale_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per ``by`` group: ``mean_<c>`` and ``std_<c>`` (population) of every column, in one pass."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError(f"cannot standardise the non-numeric column {c!r}")
    aggregates = []
    for c in columns:
        aggregates += [F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}")]
    return df.groupBy(*by).agg(*aggregates)


def _match(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join the statistics of each group to its rows."""
    renamed = stats.withColumnsRenamed({k: f"_{k}" for k in by})
    condition = F.lit(True)
    for k in by:
        condition = condition & df[k].eqNullSafe(renamed[f"_{k}"])
    return df.join(renamed, condition)


def _rescale(df: DataFrame, columns: Sequence[str], stats: DataFrame, by: Sequence[str],
             formula: Callable[[Column, Column, Column], Column]) -> DataFrame:
    if by:
        joined, value = _match(df, stats, by), F.col
    else:
        row = stats.first()  # one row: its values become literals, no join is needed
        joined, value = df, lambda name: F.lit(row[name])
    changed = {c: formula(F.col(c), value(f"mean_{c}"), value(f"std_{c}")) for c in columns}
    return joined.withColumns(changed).select(*df.columns)


def _z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std == 0, F.lit(0.0)).otherwise(F.try_divide(x - mean, std))


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                stats: DataFrame | None = None) -> DataFrame:
    """Replace ``columns`` by z-scores within each ``by`` group; constant columns become 0."""
    if stats is None:
        stats = scale_stats(df, columns, by)
    return _rescale(df, columns, stats, by, _z_score)


def destandardize(df: DataFrame, columns: Sequence[str], stats: DataFrame,
                  by: Sequence[str] = ()) -> DataFrame:
    """Inverse of :func:`standardize` with the same ``stats``."""
    return _rescale(df, columns, stats, by, lambda x, mean, std: x * std + mean)


def standardize_array(df: DataFrame, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """:func:`standardize` for an ``ARRAY<DOUBLE>`` column, by the built-in vector aggregate."""
    by = list(by)
    stats = (df.groupBy(*by)
             .agg(Summarizer.metrics("count", "mean", "variance").summary(as_vector(features)).alias("s"))
             .select(*by, vector_to_array("s.mean").alias("_mean"),
                     F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(
                         v * (F.col("s.count") - 1) / F.col("s.count"))).alias("_std")))
    if by:
        joined = _match(df, stats, by)
        mean, std = F.col("_mean"), F.col("_std")
    else:
        row = stats.first()
        joined = df
        mean, std = F.lit(row["_mean"]), F.lit(row["_std"])
    scaled = F.transform(F.arrays_zip(F.col(features).alias("x"), mean.alias("m"), std.alias("d")),
                         lambda t: _z_score(t["x"], t["m"], t["d"]))
    return joined.withColumn(features, scaled).select(*df.columns)
