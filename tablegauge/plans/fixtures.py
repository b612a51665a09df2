"""The benchmark tables as the inputs of the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class = return flag, cluster = line status."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("cluster"),
        F.year("l_shipdate").alias("year"), "l_discount", "l_quantity")


def line_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster = line status as a number, or -1 (noise) for undiscounted lines."""
    status = F.when(F.col("l_discount") < 0.005, -1).when(F.col("cluster") == "F", 0).otherwise(1)
    return line_groups(spark, sf_dir).withColumn("cluster", status)


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features; six clusters: return flag x line status."""
    return read(spark, sf_dir, "lineitem").select(
        F.array("l_quantity", "l_extendedprice").alias("features"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("cluster"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 features; cluster = the given label, class = its upper half."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("cluster"), (F.col("label") >= 5).cast("int").alias("label"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return documents.join(read(spark, sf_dir, "labels"), "doc_id")


def document_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class = quality; features: length and language."""
    languages = [F.when(F.col("lang") == c, 1.0).otherwise(0.0) for c in ("de", "en", "es", "fr")]
    return labelled_documents(spark, sf_dir).select(
        F.col("doc_id").alias("row_id"), F.array(F.ln(F.col("n_chars") + 1), *languages).alias("features"),
        F.col("quality").alias("label"))


def customers(spark: SparkSession, sf_dir: str, segment: str = "BUILDING") -> DataFrame:
    """Class = one market segment; features: balance and nation."""
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"),
        F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("features"),
        (F.col("c_mktsegment") == segment).cast("int").alias("label"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class = finished orders; feature: price."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.array("o_totalprice").alias("features"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))
