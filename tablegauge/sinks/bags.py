"""Bags and their description on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.table import Table


def write_bags(bags: DataFrame, path: str, files_per_bag_batch: int | None = None) -> None:
    """One Parquet partition per bag; fails if ``path`` exists.

    Rows are gathered by bag before writing, so a bag is one file and not one per task.
    """
    rows = bags.repartition("bag_id") if files_per_bag_batch is None \
        else bags.repartition(files_per_bag_batch, "bag_id")
    rows.write.partitionBy("bag_id").mode("errorifexists").parquet(path)


def read_bags(spark: SparkSession, path: str, bag_id: int | None = None) -> DataFrame:
    """All bags, or one of them by partition pruning."""
    bags = spark.read.parquet(path)
    return bags if bag_id is None else bags.where(F.col("bag_id") == bag_id)


def bag_metadata(table: Table, df: DataFrame | None = None, stratified: bool = True) -> DataFrame:
    """One row: time, class counts, numbers of rows and features, column names and categories."""
    rows = df if df is not None else table.df
    n_features = len(table.features)
    label = table.label
    if label:
        counts = rows.groupBy(F.col(label).cast("string").alias("l")).count()
        entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "count"))))
        base = counts.agg(entry.alias("classes"), F.sum("count").alias("n_samples"))
    else:
        base = rows.agg(F.lit(None).cast("map<string,bigint>").alias("classes"),
                        F.count(F.lit(1)).alias("n_samples"))
    return base.select(
        F.current_timestamp().alias("timestamp"), "classes", "n_samples",
        F.lit(n_features).alias("n_features"), F.array(*[F.lit(c) for c in table.features]).alias("column_names"),
        F.array(*[F.lit(c) for c in table.nominal]).cast("array<string>").alias("nominal_columns"),
        F.lit(stratified).alias("stratified_sampling"))


def write_bag_metadata(metadata: DataFrame, categories: DataFrame | None, path: str) -> None:
    """The one-row description and, beside it, the (column, category, code) dimension."""
    metadata.write.mode("errorifexists").json(f"{path}/metadata")
    if categories is not None:
        categories.write.mode("errorifexists").parquet(f"{path}/categories")
