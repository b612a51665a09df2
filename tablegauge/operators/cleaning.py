"""Projection, target choice, missing values and numeric casts."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts read as missing by default.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[iI]nf(inity)?$"


def project(df: DataFrame, usecols: Sequence[str | int] | None) -> DataFrame:
    """Keep ``usecols`` (names or positions) in table order; ``None`` keeps all."""
    if usecols is None:
        return df
    wanted = {df.columns[c] if isinstance(c, int) else c for c in usecols}
    unknown = wanted - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.select(*[c for c in df.columns if c in wanted])


def split_target(df: DataFrame, target_col: int | str | None = -1,
                 label: str = "label") -> tuple[DataFrame, list[str]]:
    """Rename the target to ``label``; return the table and its feature names.

    An integer counts within the columns of ``df`` (after projection); ``None`` means
    there is no target.
    """
    if target_col is None:
        return df, list(df.columns)
    target = df.columns[target_col] if isinstance(target_col, int) else target_col
    if target not in df.columns:
        raise ValueError(f"unknown target column: {target}")
    features = [c for c in df.columns if c != target]
    if label in features:
        raise ValueError(f"a feature is already called {label!r}")
    return df.withColumnRenamed(target, label), features


def na_to_null(df: DataFrame, na_values: object = None, keep_default: bool = True) -> DataFrame:
    """Turn missing-value texts to null; ``na_values`` is a scalar, a list or per-column lists."""
    def tokens(values: object) -> list[str]:
        if values is None:
            return []
        if isinstance(values, (str, int, float)):
            return [str(values)]
        return [str(v) for v in values]

    per_column = na_values if isinstance(na_values, Mapping) else dict.fromkeys(df.columns, na_values)
    defaults = list(DEFAULT_NA_TOKENS) if keep_default else []

    def cleaned(name: str) -> Column:
        missing = defaults + tokens(per_column.get(name))
        value = F.col(f"`{name}`")
        if not missing:
            return value
        return F.when(~F.trim(value.cast("string")).isin(missing), value).alias(name)

    return df.select(*[cleaned(c).alias(c) for c in df.columns])


def drop_missing(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Drop rows with a null feature, and those with a null label if one is named."""
    return df.dropna("any", subset=[*features, *([label] if label else [])])


def is_number(column: Column | str) -> Column:
    """Does the text hold a number?"""
    column = F.col(column) if isinstance(column, str) else column
    return F.trim(column).rlike(NUMBER_PATTERN)


def cast_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast ``columns`` to DOUBLE; text that is no number becomes null, with a warning."""
    text = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    lost = {r["column"]: r["n_text"] for r in cast_report(df, text).collect() if r["n_text"]} if text else {}
    if lost:
        warnings.warn(f"values that are no numbers became null: {lost}", stacklevel=2)
    casts = {c: F.col(c).try_cast("double") for c in columns}
    return df.withColumns(casts)


def cast_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_text)``: how many non-null values of each column are no number."""
    counts = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
              for c in columns]
    return df.agg(*counts).unpivot([], list(columns), "column", "n_text")
