"""Tables that are already DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions.numbers import nominal_limit
from tablegauge.functions.vectors import flatten_nested


def load_data(df: DataFrame, features: str = "features", label: str | None = None,
              flatten: bool = True) -> DataFrame:
    """``(features ARRAY<DOUBLE>[, label])`` with nested features flattened.

    Rows must end up with the same number of values, and no label may be null.
    """
    values = flatten_nested(df, features) if flatten else F.col(features).cast("array<double>")
    rows = df.select(values.alias("features"), *([F.col(label).alias("label")] if label else []))
    checks = rows.agg(F.min(F.size("features")).alias("lo"), F.max(F.size("features")).alias("hi"),
                      *([F.count_if(F.col("label").isNull()).alias("missing")] if label else [])).first()
    if checks["lo"] != checks["hi"]:
        raise ValueError("the number of features varies across rows")
    if label and checks["missing"]:
        raise ValueError("the number of labels doesn't match the number of rows")
    return rows


def is_class_label(df: DataFrame, label: str = "label") -> bool:
    """Do the distinct labels stay within the nominal limit for this many rows?"""
    n = df.count()
    limit = int(nominal_limit(n))
    return df.select(label).distinct().limit(limit + 1).count() <= limit
