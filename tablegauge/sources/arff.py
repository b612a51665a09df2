"""ARFF files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.operators.cleaning import drop_missing
from tablegauge.operators.encoding import encode
from tablegauge.session import broadcast_if_small
from tablegauge.sources.csv import BAD_ROW, refuse
from tablegauge.sources.lines import numbered_lines
from tablegauge.table import Table

# Attribute types that hold numbers.
NUMERIC_TYPES = ("numeric", "real", "integer")

ATTRIBUTE = re.compile(r"""^\s*@attribute\s+('[^']*'|"[^"]*"|\S+)\s+(.+?)\s*$""", re.IGNORECASE)


def parse_attributes(lines: Sequence[str]) -> list[tuple[str, str]]:
    """``(name, 'numeric' | 'nominal')`` of every ``@attribute`` line, in order."""
    attributes = []
    for line in lines:
        match = ATTRIBUTE.match(line)
        if not match:
            continue
        name, kind = match.group(1).strip("'\""), match.group(2)
        if kind.startswith("{"):
            attributes.append((name, "nominal"))
        elif kind.split()[0].lower() in NUMERIC_TYPES:
            attributes.append((name, "numeric"))
        else:
            raise NotImplementedError(f"attribute {name!r} has the unsupported type {kind!r}")
    return attributes


def read_arff_columns(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(data with ``?`` as null, attributes); only header lines reach the driver.

    Every file under ``path`` has a header of its own, ended by its first ``@data`` line; all
    must state the attributes of the first.  What follows ``@data`` is data, whatever it starts
    with.  A row with another number of fields, or a text in a numeric attribute, fails the job.
    """
    lines = numbered_lines(spark, path, per_file=True)
    text = F.lower(F.ltrim("value"))
    # One row per file: where its data begin.
    starts = lines.where(text.startswith("@data")).groupBy("file").agg(F.min("line_no").alias("data_line"))
    placed = lines.join(broadcast_if_small(starts, 2), "file")
    header = placed.where((F.col("line_no") < F.col("data_line")) & text.startswith("@attribute"))
    headers = header.groupBy("file").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("lines"))
    found = headers.select("lines").distinct().limit(2).collect()
    if not found:
        raise ValueError("the file has no attributes or no data section")
    attributes = parse_attributes(found[0]["lines"])
    if len(found) > 1 and parse_attributes(found[1]["lines"]) != attributes:
        raise ValueError("the files have different attributes")
    data = placed.where((F.col("line_no") > F.col("data_line")) & ~text.startswith("%") & (F.trim("value") != ""))
    schema = ", ".join([*(f"a{i} string" for i in range(len(attributes))), f"{BAD_ROW} string"])
    parsed = data.select("value", "line_no", "data_line", F.from_csv("value", schema, {
        "sep": ",", "quote": "'", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true",
        "columnNameOfCorruptRecord": BAD_ROW}).alias("r"))
    bad, columns = F.col(f"r.{BAD_ROW}").isNotNull(), []
    for i, (name, kind) in enumerate(attributes):
        raw = F.col(f"r.a{i}")
        value = F.when(raw != "?", raw)
        if kind == "numeric":
            bad = bad | (value.isNotNull() & value.try_cast("double").isNull())
            value = value.try_cast("double")
        columns.append(value.alias(name))
    # Ties the check to the line number, so that it is not made on header lines.
    return refuse(parsed, (F.col("line_no") > F.col("data_line")) & bad, F.col("value")).select(*columns), attributes


def read_arff(spark: SparkSession, path: str, target_attr: str | None = "class",
              encode_target: bool | str = "infer",
              numeric_categorical_attrs: Sequence[str] | None = None,
              drop_na_rows: bool = True, label: str = "label") -> Table:
    """Read, clean and encode an ARFF file; every nominal attribute is encoded."""
    df, attributes = read_arff_columns(spark, path)
    kinds = dict(attributes)
    if target_attr is not None and target_attr not in kinds:
        raise ValueError("unknown target attribute")
    features = [name for name, _ in attributes if name != target_attr]
    if target_attr is not None:
        df = df.withColumnRenamed(target_attr, label)
        if isinstance(encode_target, str):
            encode_target = kinds[target_attr] == "nominal"
    if drop_na_rows:
        df = drop_missing(df, features, label if target_attr is not None else None)
    nominal = [c for c in features
               if kinds[c] == "nominal" or c in (numeric_categorical_attrs or ())]
    table = Table(df, tuple(features), label if target_attr is not None else None)
    return encode(table, nominal, bool(encode_target))
