"""Overlapping stratified bags, train/test splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions.numbers import hash_number, next_prime
from tablegauge.operators.ranking import hash_rank
from tablegauge.session import materialize

#: Candidates one array of the draw may hold; larger quotas are drawn in pieces.
DRAW_CHUNK = 10_000


class BagPlan(NamedTuple):
    n_samples: int
    sample_size: int
    n_bags: int


def bag_plan(n_samples: int, oneshot: bool = False) -> BagPlan:
    """Size and number of the bags: all rows once, or 500 (half, below 1001) rows many times."""
    if oneshot:
        return BagPlan(n_samples, n_samples, 1)
    if n_samples > 1000:
        size = 500
    elif n_samples > 500:
        size = n_samples // 2
    else:
        raise ValueError("a table of 500 rows or fewer is too small for sub-sampling; use oneshot")
    return BagPlan(n_samples, size, round(5 * n_samples / (0.63 * size)))


def bag_plan_columns(n: Column) -> list[Column]:
    """:func:`bag_plan` for sub-sampling as expressions; null where the table is too small."""
    size = F.when(n > 1000, F.lit(500)).when(n > 500, F.floor(n / 2).cast("int"))
    bags = F.bround(F.lit(5) * n / (F.lit(0.63) * size)).cast("bigint")
    return [n.alias("n_samples"), size.cast("bigint").alias("sample_size"), bags.alias("n_bags")]


def sample_fraction(sample_size: int | float, n_samples: int) -> float:
    """An absolute size or a share of the rows -> the share."""
    if isinstance(sample_size, bool):
        raise ValueError("invalid sample size")
    if isinstance(sample_size, int) and 0 < sample_size <= n_samples:
        return sample_size / n_samples
    if isinstance(sample_size, float) and 0.0 < sample_size <= 1.0:
        return sample_size
    raise ValueError("invalid sample size")


def bag_quotas(counts: DataFrame, fraction: float) -> DataFrame:
    """``(label, count, quota)``: half-even rounded share of every class."""
    return counts.withColumn("quota", F.bround(F.lit(fraction) * F.col("count")).cast("bigint"))


@F.pandas_udf(T.LongType())
def _prime_from(sizes: pd.Series) -> pd.Series:
    """The least prime at or above each size."""
    return sizes.map(next_prime)


def draw_positions(quotas: DataFrame, n_bags: int, seed: int = 42) -> DataFrame:
    """``(bag_id, label, pos)``: for every bag and class, ``quota`` distinct positions.

    ``quotas`` has a row ``(label, count, quota)`` per class.  Class positions are permuted by
    ``j -> (a*j + c) mod p`` with a prime ``p`` at or above the class size and ``a``, ``c`` taken
    from a hash of (seed, bag, label).  A permutation cannot repeat, and at most ``p - n`` images
    fall outside the class, so ``quota + p - n`` candidates always suffice.  The number of classes
    does not show in the plan.
    """
    classes = quotas.where("quota > 0").withColumn("p", _prime_from("count"))
    classes = classes.withColumn("needed", F.col("quota") + F.col("p") - F.col("count"))
    key = F.concat_ws("-", F.lit(str(seed)), F.col("bag_id").cast("string"), F.col("label").cast("string"))
    # The number of rows is not that of the input: classes are spread before they unfold.
    plan = (classes.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_bags))).alias("bag_id"))
            .withColumn("a", hash_number(F.concat(F.lit("a-"), key)) % F.greatest(F.lit(1), F.col("p") - 1) + 1)
            .withColumn("c", hash_number(F.concat(F.lit("c-"), key)) % F.col("p")))
    a, c, p = F.col("a"), F.col("c"), F.col("p")
    # The product a*j needs more than 64 bits only for very large classes.
    narrow = p.cast("double") * F.col("needed") < 2.0 ** 62
    wide = "decimal(38,0)"

    def image(j: Column) -> Column:
        return F.when(narrow, (a * j + c) % p).otherwise(((a.cast(wide) * j.cast(wide) + c) % p.cast(wide)).cast("bigint"))

    def kept(start: Column, stop: Column) -> Column:
        return F.filter(F.transform(F.sequence(start, stop), image), lambda x: x < F.col("count"))

    zero = F.lit(0).cast("bigint")
    small = plan.where(F.col("needed") <= DRAW_CHUNK)
    drawn = small.select("bag_id", "label", F.explode(F.slice(kept(zero, F.col("needed") - 1), F.lit(1), F.col("quota").cast("int"))).alias("pos"))
    # Many positions are drawn in pieces, each told how many come before it.
    large = plan.where(F.col("needed") > DRAW_CHUNK).withColumn(
        "start", F.explode(F.sequence(zero, F.col("needed") - 1, F.lit(DRAW_CHUNK).cast("bigint"))))
    stop = F.least(F.col("start") + DRAW_CHUNK - 1, F.col("needed") - 1)
    before = Window.partitionBy("bag_id", "label").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = large.repartition("label", "bag_id", "start").withColumn("n_kept", F.size(kept(F.col("start"), stop)))
    pieces = counted.withColumn("done", F.coalesce(F.sum("n_kept").over(before), zero))
    left = F.greatest(zero, F.col("quota") - F.col("done")).cast("int")
    return drawn.unionByName(pieces.select("bag_id", "label", F.explode(F.slice(kept(F.col("start"), stop), F.lit(1), left)).alias("pos")))


def draw_bags(df: DataFrame, n_bags: int, sample_size: int | float, label: str = "label",
              row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Rows of ``df`` per ``bag_id``: stratified, without repeats in a bag, overlapping across bags.

    One shuffle ranks the rows within their class in hash order, one equi-join on
    (class, position) brings the drawn rows; both keys are unique on the row side.
    """
    counts = materialize(df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count").alias("n"), F.max("count").alias("largest"), F.count_if(F.col("label").isNull()).alias("nulls")).first()
    if not total["n"] or total["nulls"]:
        raise ValueError("bags need a class label on every row")
    fraction = sample_fraction(sample_size, total["n"])
    if fraction == 1.0:
        every = F.explode(F.sequence(F.lit(1), F.lit(n_bags))) if n_bags > 1 else F.lit(1)
        return df.select(every.alias("bag_id"), *df.columns)
    ranked = hash_rank(df, [label], row_id, seed, total["largest"])
    draws = draw_positions(bag_quotas(counts, fraction), n_bags, seed).withColumnRenamed("label", label)
    # The optimizer cannot see how many rows the draws unfold to, so a broadcast is ruled out.
    return draws.hint("merge").join(ranked, [label, "pos"]).drop("pos").select("bag_id", *df.columns)


def sample_table(df: DataFrame, oneshot: bool = False, label: str = "label",
                 row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Bags by the standard plan: see :func:`bag_plan` and :func:`draw_bags`."""
    plan = bag_plan(df.count(), oneshot)
    return draw_bags(df, plan.n_bags, plan.sample_size, label, row_id, seed)


def stratified_split(df: DataFrame, test_fraction: float = 0.3, label: str = "label",
                     row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Add ``is_test``: the first ``round(test_fraction * n)`` rows of each class in hash order."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(
        F.bround(F.count(F.lit(1)) * F.lit(test_fraction)).cast("bigint").alias("_q"))
    ranked = hash_rank(df, [label], row_id, seed)
    # One row per class.
    return (ranked.join(F.broadcast(counts), ranked[label].eqNullSafe(F.col("_l")))
            .withColumn("is_test", F.col("pos") < F.col("_q")).drop("pos", "_l", "_q"))


def stratified_folds(df: DataFrame, n_folds: int = 5, label: str = "label",
                     row_id: str = "row_id", seed: int = 42, out: str = "fold") -> DataFrame:
    """Add a fold number 0..n_folds-1 that splits every class evenly."""
    ranked = hash_rank(df, [label], row_id, f"fold-{seed}")
    return ranked.withColumn(out, (F.col("pos") % n_folds).cast("int")).drop("pos")
