"""Reader choice by file suffix."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablegauge.operators.encoding import dummy_code_table
from tablegauge.sources.arff import read_arff
from tablegauge.sources.csv import read_csv
from tablegauge.sources.libsvm import read_libsvm
from tablegauge.table import Table

READERS = {"csv": read_csv, "libsvm": read_libsvm, "arff": read_arff}


def file_format(path: str) -> str:
    """The format a path's suffix stands for."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in READERS:
        raise ValueError(f"unsupported data format: {suffix!r}" if suffix
                         else "the path has no suffix that names its data format")
    return suffix


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None, **options) -> Table:
    """Read a table of any supported format and dummy-code its nominal features."""
    fmt = fmt or file_format(path)
    if fmt not in READERS:
        raise ValueError(f"unsupported data format: {fmt!r}")
    return dummy_code_table(READERS[fmt](spark, path, **options))
