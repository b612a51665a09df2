"""Delimited text files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.cleaning import drop_missing, is_number, na_to_null, project, split_target
from tablegauge.operators.encoding import encode
from tablegauge.sources.lines import drop_comments, first_lines, numbered_lines, skip_lines, split_header
from tablegauge.table import Table

WHITESPACE = r"\s+"
BAD_ROW = "_bad_row"


def refuse(df: DataFrame, bad: Column, line: Column) -> DataFrame:
    """``df``; reading a row for which ``bad`` holds fails and names its ``line``."""
    message = F.concat(F.lit("malformed row: "), F.coalesce(line, F.lit("")))
    return df.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def read_csv_columns(spark: SparkSession, path: str, sep: str = ",",
                     skiprows: int | Sequence[int] | None = None, header_row: int | None = None,
                     nrows: int | None = None, comment: str | None = None) -> DataFrame:
    """Every column as STRING, leading blanks trimmed; without a header they are ``c0, c1, ...``.

    ``sep`` may be a regular expression (more than one character).  Plain layouts go
    through the built-in reader; shifted headers, skips, limits and regular expressions
    go through numbered lines.  Quoted line breaks are not supported.  A row with more or
    fewer fields than the first one fails the job that reads it.
    """
    regex = len(sep) > 1
    plain = not regex and skiprows is None and nrows is None and header_row in (None, 0)
    if plain and (comment is None or len(comment) == 1):
        options = {"sep": sep, "header": header_row == 0, "inferSchema": False,
                   "ignoreLeadingWhiteSpace": True, "mode": "PERMISSIVE", "enforceSchema": False}
        if comment:
            options["comment"] = comment
        names = [c.strip() for c in spark.read.options(**options).csv(path).columns]
        if header_row is None:
            names = [f"c{i}" for i in range(len(names))]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*(f"c{i}" for i in range(len(names))), BAD_ROW]])
        options |= {"columnNameOfCorruptRecord": BAD_ROW, "enforceSchema": True}
        df = spark.read.options(**options).schema(schema).csv(path)
        return refuse(df, F.col(BAD_ROW).isNotNull(), F.col(BAD_ROW)).drop(BAD_ROW).toDF(*names)

    lines = drop_comments(skip_lines(numbered_lines(spark, path), skiprows), comment)
    first, data = split_header(lines, header_row)
    data = first_lines(data, nrows)

    # Ties the check to the line number, so that it is not made before lines are skipped.
    placed = F.col("line_no") >= 0
    sample = spark.range(1).select(F.lit(first).alias("value"))
    if regex:
        text = F.trim("value") if sep == WHITESPACE else F.col("value")
        row = F.split(text, sep)
        names = [v.strip() for v in sample.select(row).first()[0]]
        data = refuse(data, placed & (F.size(row) != len(names)), F.col("value"))
        columns = [F.ltrim(F.get(row, F.lit(i))) for i in range(len(names))]
    else:
        options = {"sep": sep, "ignoreLeadingWhiteSpace": "true"}
        width = first.count(sep) + 1
        schema = ", ".join(f"c{i} string" for i in range(width))
        # One record -> its fields, by the built-in parser.
        names = list(sample.select(F.from_csv("value", schema, options).alias("r")).select("r.*").first())
        while '"' in first and names[-1] is None:
            names.pop()  # separators inside quotes were counted as well
        schema = ", ".join([*(f"c{i} string" for i in range(len(names))), f"{BAD_ROW} string"])
        data = data.withColumn("_r", F.from_csv("value", schema, options | {"columnNameOfCorruptRecord": BAD_ROW}))
        data = refuse(data, placed & F.col("_r").getField(BAD_ROW).isNotNull(), F.col("value"))
        columns = [F.col("_r").getField(f"c{i}") for i in range(len(names))]
        names = [(v or f"c{i}").strip() for i, v in enumerate(names)]
    if header_row is None:
        names = [f"c{i}" for i in range(len(names))]
    return data.select(*[c.alias(n) for c, n in zip(columns, names)])


def infer_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast to DOUBLE the STRING columns whose non-null values are all numbers (one pass)."""
    columns = list(columns if columns is not None else df.columns)
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & ~is_number(c)).alias(c) for c in columns]).first()
    return df.withColumns({c: F.trim(c).try_cast("double") for c in columns if bad[c] == 0})


def read_csv(spark: SparkSession, path: str, sep: str = ",",
             skiprows: int | Sequence[int] | None = None, header_row: int | None = None,
             usecols: Sequence[str | int] | None = None, target_col: int | str | None = -1,
             encode_target: bool = True, categorical_cols: object = "infer",
             na_values: object = None, nrows: int | None = None, comment: str | None = None,
             label: str = "label") -> Table:
    """Read, clean and encode a delimited file.

    Rows with a missing feature or target are dropped.  Columns given by position are
    positions in the file; ``target_col`` counts within the columns kept by ``usecols``.
    """
    df = read_csv_columns(spark, path, sep, skiprows, header_row, nrows, comment)
    if isinstance(na_values, Mapping):
        na_values = {f"c{k}" if isinstance(k, int) else k: v for k, v in na_values.items()}
    df = na_to_null(project(df, usecols), na_values)
    df, features = split_target(df, target_col, label)
    has_label = target_col is not None
    df = drop_missing(infer_numeric(df), features, label if has_label else None)
    table = Table(df, tuple(features), label if has_label else None)
    return encode(table, categorical_cols, encode_target)
