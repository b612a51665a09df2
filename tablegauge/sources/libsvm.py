"""LIBSVM files."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.operators.encoding import label_encode
from tablegauge.table import Table


def read_libsvm_vectors(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """``(label DOUBLE, features sparse vector)``; file index 1 is vector position 0."""
    reader = spark.read.format("libsvm")
    if n_features is not None:
        reader = reader.option("numFeatures", str(n_features))
    return reader.load(path)


def read_libsvm(spark: SparkSession, path: str, type: str = "classification",
                n_features: int | None = None) -> Table:
    """Read a LIBSVM file into columns ``f1, f2, ...`` and a label.

    Class labels are cut to integers and encoded; ``'regression'`` keeps them raw.
    """
    kind = type.casefold()
    if kind == "ranking":
        raise NotImplementedError("ranking tables are not supported")
    vectors = read_libsvm_vectors(spark, path, n_features)
    if n_features is None:
        n_features = vectors.schema["features"].metadata.get("numFeatures")
        if n_features is None:
            first = vectors.select(F.size(vector_to_array("features"))).first()
            n_features = first[0] if first else 0
    names = [f"f{i + 1}" for i in range(int(n_features))]
    dense = vectors.select(vector_to_array("features").alias("v"), "label")
    df = dense.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)], "label")
    categories = None
    if kind == "classification":
        df = df.withColumn("label", F.col("label").cast("bigint"))
        df, categories = label_encode(df, ["label"])
    return Table(df, tuple(names), "label", (), categories)
