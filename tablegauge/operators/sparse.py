"""Tables of many columns: one sparse vector per row, and a dimension that names its positions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import OneHotEncoder, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.operators.ranking import number_rows
from tablegauge.session import materialize
from tablegauge.sources.libsvm import read_libsvm_vectors
from tablegauge.table import Table


@dataclass(frozen=True)
class SparseTable:
    """``rows (row_id, label, features VECTOR)`` and ``positions (position, column, value)``.

    ``value`` is the category whose presence the position states, null for a number.  No list of
    columns exists anywhere: a table may have millions of positions.
    """

    rows: DataFrame
    positions: DataFrame
    width: int

    def scaled(self) -> SparseTable:
        """Every position divided by its population deviation; zeros stay zeros, so rows stay sparse."""
        n = self.rows.count()
        # The scaler divides by the sample deviation.
        model = StandardScaler(inputCol="features", outputCol="_scaled", withMean=False, withStd=True).fit(self.rows)
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        return replace(self, rows=_times(model.transform(self.rows), "_scaled", factor).drop("_scaled"))

    def moments(self, by: Sequence[str] = ()) -> DataFrame:
        """``(by..., position, n, mean, std, non_zeros)`` of every position, by the vector aggregate."""
        by = list(by)
        stats = self.rows.groupBy(*by).agg(
            Summarizer.metrics("count", "mean", "variance", "numNonZeros").summary(F.col("features")).alias("s"))
        n = F.col("s.count")
        columns = F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"),
                               vector_to_array("s.numNonZeros").alias("non_zeros"))
        return (stats.select(*by, n.alias("n"), F.posexplode(columns).alias("position", "x"))
                .select(*by, F.col("position").cast("bigint").alias("position"), "n", F.col("x.mean").alias("mean"),
                        F.sqrt(F.col("x.variance") * (F.col("n") - 1) / F.col("n")).alias("std"),
                        F.col("x.non_zeros").cast("bigint").alias("non_zeros")))


def _times(df: DataFrame, column: str, factor: float) -> DataFrame:
    """``features``: a sparse vector column times a number."""
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    width = df.select(column).first()
    if width is None or factor == 1.0:
        return df.withColumn("features", F.col(column))
    product = ElementwiseProduct(scalingVec=Vectors.dense([factor] * width[0].size), inputCol=column, outputCol="_product")
    return product.transform(df).withColumn("features", F.col("_product")).drop("_product")


def sparse_dummies(table: Table, drop_first: bool = False, row_id: str | None = None) -> SparseTable:
    """The numbers of an encoded ``table`` and a 0/1 position per category of its nominal features.

    Positions follow the order of numbers, then of nominal features, then of codes.  The number of
    categories has no limit: each nominal feature stays one code column until it becomes a sparse
    vector, and the categories are rows of the dimension.
    """
    df = table.df
    if row_id is None:
        df, row_id = number_rows(df, "_sparse_id"), "_sparse_id"
    nominal = [c for c in table.features if c in set(table.nominal)]
    numbers = [c for c in table.features if c not in set(table.nominal)]
    if nominal and table.categories is None:
        raise ValueError("the codes of nominal features need their categories")
    counts = {}
    if nominal:
        known = materialize(table.categories.where(F.col("column").isin(nominal)).select("column", "category", F.col("code").cast("bigint").alias("code")))
        # One row per nominal feature.
        counts = {r["column"]: r["n"] for r in known.groupBy("column").agg((F.max("code") + 1).alias("n")).collect()}
    start, at = {}, len(numbers)
    for c in nominal:
        start[c] = at
        at += max(0, counts.get(c, 0) - (1 if drop_first else 0))
    parts, coded = [*numbers], df.withColumns({c: F.col(c).cast("double") for c in numbers})
    live = [c for c in nominal if counts.get(c, 0) > (1 if drop_first else 0)]
    if live:
        # The encoder can leave out the last category only: the first one is moved there.
        place = lambda c: F.pmod(F.col(c) - 1, F.lit(counts[c])) if drop_first else F.col(c)
        coded = coded.withColumns({f"_{c}_code": place(c).cast("double") for c in live})
        sizes = df.sparkSession.createDataFrame([tuple(float(counts[c] - 1) for c in live)], [f"_{c}_code" for c in live])
        encoder = OneHotEncoder(inputCols=[f"_{c}_code" for c in live], outputCols=[f"_{c}_hot" for c in live], dropLast=drop_first)
        # Fitted to the number of categories, not to the codes that the rows happen to hold.
        coded = encoder.fit(sizes).transform(coded)
        parts += [f"_{c}_hot" for c in live]
    if not parts:
        raise ValueError("the table has no features")
    rows = VectorAssembler(inputCols=parts, outputCol="_vector").transform(coded)
    label = [F.col(table.label).alias("label")] if table.label else []
    rows = rows.select(F.col(row_id).alias("row_id"), *label, F.col("_vector").alias("features"))
    spark = df.sparkSession
    positions = spark.createDataFrame([(i, c, None) for i, c in enumerate(numbers)], "position bigint, column string, value string")
    if live:
        first = F.create_map(*[x for c in live for x in (F.lit(c), F.lit(start[c]))])
        shift = 1 if drop_first else 0
        named = known.where(F.col("column").isin(live) & (F.col("code") >= shift))
        positions = positions.unionByName(named.select(
            (first[F.col("column")] + F.col("code") - shift).cast("bigint").alias("position"), "column", F.col("category").alias("value")))
    return SparseTable(rows, positions, at)


def read_libsvm_sparse(spark: SparkSession, path: str, n_features: int | None = None) -> SparseTable:
    """A LIBSVM file without a column per feature: ``f<i>`` is a row of the positions."""
    vectors = number_rows(read_libsvm_vectors(spark, path, n_features), "row_id")
    if n_features is None:
        first = vectors.select("features").first()
        n_features = first[0].size if first else 0
    positions = spark.range(n_features).select(
        F.col("id").alias("position"), F.concat(F.lit("f"), (F.col("id") + 1).cast("string")).alias("column"), F.lit(None).cast("string").alias("value"))
    return SparseTable(vectors.select("row_id", "label", "features"), positions, int(n_features))
