"""Column expressions on numeric arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_features(columns: Sequence[str]) -> Column:
    """Named numeric columns -> ``ARRAY<DOUBLE>``."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two arrays of equal length."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, v: acc + v)


def euclidean_distance(a: Column | str, b: Column | str, squared: bool = False) -> Column:
    """Euclidean distance of two arrays, or its square."""
    d2 = squared_distance(a, b)
    return d2 if squared else F.sqrt(d2)


def flatten_nested(df: DataFrame, column: str) -> Column:
    """Arrays nested to any (fixed) depth -> one flat ``ARRAY<DOUBLE>``.

    Structs are read as ragged siblings: their fields are flattened in order.
    """
    def flat(expr: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.ArrayType):
            inner = dtype.elementType
            if isinstance(inner, (T.ArrayType, T.StructType)):
                return F.flatten(F.transform(expr, lambda x: flat(x, inner)))
            return F.transform(expr, lambda x: x.cast("double"))
        if isinstance(dtype, T.StructType):
            return F.concat(*[flat(expr.getField(f.name), f.dataType) for f in dtype.fields])
        if isinstance(dtype, T.NumericType):
            return F.array(expr.cast("double"))
        raise ValueError(f"cannot flatten non-numerical features of type {dtype.simpleString()}")

    return flat(F.col(column), df.schema[column].dataType)


def as_vector(column: Column | str) -> Column:
    """``ARRAY<numeric>`` -> ML vector, for the built-in vector aggregates."""
    column = F.col(column) if isinstance(column, str) else column
    return array_to_vector(column.cast("array<double>"))
