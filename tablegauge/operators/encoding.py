"""Nominal columns: inference, label codes and dummy columns."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.numbers import nominal_limit_column
from tablegauge.operators.ranking import global_rank
from tablegauge.session import broadcast_if_small, materialize
from tablegauge.table import Table

#: Dummy columns one table may get; more belong in a sparse vector.
MAX_DUMMY_COLUMNS = 5_000


def string_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_distinct, n_rows, nominal_limit, is_nominal)``, exact counts.

    The distinct values are counted after one pass that turns columns into rows: the
    aggregation is keyed by ``(column, value)``, so it combines before the shuffle.
    """
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], list(columns), "column", "value"))
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (values.groupBy("column")
            .agg(F.count("value").alias("n_distinct"), F.sum("n").alias("n_rows"))
            .withColumn("nominal_limit", nominal_limit_column(F.col("n_rows")))
            .withColumn("is_nominal", F.col("n_distinct") <= F.col("nominal_limit")))


def infer_nominal(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split the string columns into (nominal, to drop) by the distinct-value limit.

    All counts are exact: the distinct values are counted once, for all columns together.
    """
    names = string_columns(df, columns)
    if not names:
        return [], []
    kept = {r["column"] for r in distinct_counts(df, names).where("is_nominal").collect()}
    nominal = [c for c in names if c in kept]
    return nominal, [c for c in names if c not in nominal]


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, category)``: the distinct values of all ``columns`` as text, from one pass."""
    long = (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], list(columns), "column", "category"))
    return materialize(long.where("category is not null").distinct())


def category_codes(values: DataFrame, column: str, dtype: T.DataType) -> DataFrame:
    """``(column, value, category, code)``: the code is the rank among the sorted values.

    ``values`` comes from :func:`distinct_values`; numbers rank as numbers.
    """
    own = values.where(F.col("column") == column).withColumn("value", F.col("category").cast(dtype))
    return global_rank(own, ["value"], "code")


def label_encode(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Replace ``columns`` by their codes; also return ``(column, category, code)``.

    Unknown names are skipped with a warning.
    """
    known = []
    for name in columns:
        if name in df.columns:
            known.append(name)
        else:
            warnings.warn(f"column {name!r} is unknown and was skipped", stacklevel=2)
    if not known:
        return df, None
    values, dimension = distinct_values(df, known), None
    for name in known:
        codes = category_codes(values, name, df.schema[name].dataType)
        order = df.columns
        lookup = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = (df.join(broadcast_if_small(lookup, 2), df[name] == F.col("_v"), "left")
              .withColumn(name, F.col("_c")).select(*order))
        part = codes.select("column", "category", "code")
        dimension = part if dimension is None else dimension.unionByName(part)
    return df, dimension


def encode(table: Table, categorical: str | int | Sequence | None = "infer",
           encode_target: bool = True) -> Table:
    """Encode the nominal features and the label of ``table``.

    ``categorical``: ``'infer'`` encodes string columns below the distinct-value limit
    and drops wider ones, ``'all'`` encodes every feature, a list those named,
    ``None`` none.
    """
    df, features = table.df, list(table.features)
    if categorical is None:
        nominal, dropped = [], []
    elif categorical == "infer":
        nominal, dropped = infer_nominal(df, features)
    elif categorical == "all":
        nominal, dropped = list(features), []
    elif isinstance(categorical, (str, int, list, tuple)):
        names = [categorical] if isinstance(categorical, (str, int)) else list(categorical)
        nominal, dropped = [f"c{c}" if isinstance(c, int) else c for c in names], []
    else:
        raise TypeError("categorical must be 'infer', 'all', a list of columns or None")
    df = df.drop(*dropped)
    features = [c for c in features if c not in dropped]
    to_code = nominal + ([table.label] if encode_target and table.label else [])
    df, dimension = label_encode(df, to_code)
    nominal = [c for c in nominal if c in features]
    return table.with_df(df, features, nominal=tuple(nominal), categories=dimension)


def dummy_code(df: DataFrame, nominal: Sequence[str], drop_first: bool = False,
               categories: DataFrame | None = None) -> DataFrame:
    """Replace code columns by 0/1 columns ``<column>_<code>`` after the other columns.

    Unknown names are skipped with a warning.
    """
    known = [c for c in df.columns if c in set(nominal)]
    for name in nominal:
        if name not in known:
            warnings.warn(f"column {name!r} is unknown and was ignored", stacklevel=2)
    if not known:
        return df
    if categories is None:
        long = (df.select(*[F.col(c).cast("string").alias(c) for c in known])
                .unpivot([], known, "column", "value").where("value is not null"))
        found = long.distinct()
    else:
        found = (categories.where(F.col("column").isin(known))
                 .select("column", F.col("code").cast("string").alias("value")))
    # The collected list is bounded: more columns than this are refused.
    rows = found.limit(MAX_DUMMY_COLUMNS + 1).collect()
    if len(rows) > MAX_DUMMY_COLUMNS:
        raise ValueError(f"more than {MAX_DUMMY_COLUMNS} dummy columns; sparse_dummies has no such limit")
    levels: dict[str, list[str]] = {c: [] for c in known}
    for row in rows:
        levels[row["column"]].append(row["value"])

    def order(text: str):
        try:
            return (0, float(text), text)
        except ValueError:
            return (1, 0.0, text)

    dummies = [F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0).alias(f"{c}_{v}")
               for c in known for v in sorted(levels[c], key=order)[1 if drop_first else 0:]]
    return df.select(*[c for c in df.columns if c not in known], *dummies)


def dummy_code_table(table: Table, nominal: str | int | Sequence | None = "infer",
                     drop_first: bool = False) -> Table:
    """Dummy-code the nominal features of ``table`` (``'infer'``: those that were encoded)."""
    if nominal is None or nominal == []:
        return table
    if nominal == "infer":
        names = list(table.nominal)
    elif nominal == "all":
        names = list(table.features)
    elif isinstance(nominal, (str, int, list, tuple)):
        names = [nominal] if isinstance(nominal, (str, int)) else list(nominal)
        names = [f"c{c}" if isinstance(c, int) else c for c in names]
    else:
        raise TypeError("nominal must be 'infer', 'all', a list of columns or None")
    coded = dummy_code(table.df, names, drop_first)
    features = [c for c in coded.columns if c in table.features or c not in table.df.columns]
    rest = [c for c in coded.columns if c not in features]
    return table.with_df(coded.select(*features, *rest), features, nominal=())


def dummy_vector(df: DataFrame, nominal: Sequence[str], out: str = "dummies") -> DataFrame:
    """Sparse one-hot vector of code columns, for category sets too wide for columns."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler

    hot = [f"_{c}_hot" for c in nominal]
    encoder = OneHotEncoder(inputCols=list(nominal), outputCols=hot, dropLast=False)
    encoded = encoder.fit(df).transform(df)
    return VectorAssembler(inputCols=hot, outputCol=out).transform(encoded).drop(*hot)
