"""Exact duplicates by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import SPACES, fresh, id_and_text, without
from tablegauge.session import broadcast_if_small, materialize

#: Rows of one digest from which on its group is dealt over several salts.
HOT_ROWS = 5_000
SALTS = 64


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chars`` for every row of ``docs``.

    Texts are equal when they are identical without white space.  The stages:

    1. each map task combines its own rows of equal (digest, content);
    2. rows of hot digests meet per salt, all others at once, again by full content;
    3. the winners of the salts meet; content decides here too.

    A content travels once; what stage 3 moves is a row of numbers, and the text only of hot
    groups.  The row with most code points in the original text stays, then the smallest id.
    Two contents under one SHA-256, xxHash and length stop the job instead of being merged.

    Null texts count as empty, so do texts of white space; they form one group.  A null id
    comes after all others and is kept only in a group without any id.  Rows repeated with the
    same id, content and length cannot be told apart and share one verdict.  An empty table
    gives no rows; other columns are ignored.
    """
    body = without(F.col("text"), SPACES)
    rows = (id_and_text(docs, id_column, text_column)
            .select("doc_id", F.char_length("text").alias("n_chars"), body.alias("body"))
            .select("doc_id", "n_chars", "body", F.sha2("body", 256).alias("digest"),
                    F.xxhash64("body").alias("mix"), F.octet_length("body").alias("n_bytes")))
    key = ["digest", "mix", "n_bytes"]

    hot = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
                      .where(F.col("n") > hot_rows).select("digest", F.lit(True).alias("hot")))
    # One number orders a group: code points first, then the id from small to large, null last.
    low = F.coalesce(F.lit(Decimal(2**63)) - F.col("doc_id").cast("decimal(19,0)"), F.lit(Decimal(0)))
    rank = (F.col("n_chars").cast("decimal(10,0)") * F.lit(Decimal(10**20)) + low).cast("decimal(38,0)")
    is_hot = F.coalesce("hot", F.lit(False))
    dealt = (rows.join(broadcast_if_small(hot), "digest", "left")
             .select(*key, "body", rank.alias("rank"), is_hot.alias("hot"),
                     F.when(is_hot, F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(salts))).otherwise(0).alias("salt")))
    winners = dealt.groupBy(*key, "body", "hot", "salt").agg(F.max("rank").alias("rank"),
                                                             F.count(F.lit(1)).alias("n"))
    groups = (winners.select(*key, F.when(F.col("hot"), F.col("body")).alias("hot_body"), "hot", "rank", "n")
              .groupBy(*key, "hot", "hot_body")
              .agg(F.max("rank").alias("rank"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_rows")))
    # Cold groups come in one row each; any second row of a key is another content.
    groups = groups.groupBy(*key).agg(
        F.max("rank").alias("rank"), F.sum("n").alias("group_size"),
        F.sum(F.when(F.col("hot"), 1).otherwise(F.col("n_rows"))).alias("contents"))
    tail = F.col("rank") % F.lit(Decimal(10**20))
    checked = F.when(F.col("contents") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share SHA-256, xxHash and length")).cast("bigint"))
    groups = groups.select(
        *key, checked.alias("group_size"),
        F.when(tail > 0, (F.lit(Decimal(2**63)) - tail).cast("bigint")).alias("keep_id"),
        F.floor(F.col("rank") / F.lit(Decimal(10**20))).cast("int").alias("most"))
    return (rows.select("doc_id", "n_chars", *key).join(groups, key)
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))).alias("kept"),
                    F.col("digest").alias("text_sha256"), F.col("n_chars").cast("bigint").alias("n_chars")))


def without_copies(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """One row of each group of equal texts of ``docs``, with all its columns.

    Rows that :func:`exact_duplicates` cannot tell apart are one document: one of them stays.
    """
    verdicts = materialize(exact_duplicates(docs, text_column=text_column))
    dropped = verdicts.where(~F.col("kept")).select("doc_id", "text_sha256", "n_chars").distinct()
    repeated = (verdicts.where("kept").groupBy("doc_id", "text_sha256", "n_chars").agg(F.count(F.lit(1)).alias("n"))
                .where("n > 1").drop("n"))
    digest, size = fresh(docs, "digest", "size")
    text = F.coalesce(F.col(text_column), F.lit(""))
    marked = docs.withColumn(digest, F.sha2(without(text, SPACES), 256)).withColumn(size, F.char_length(text).cast("bigint"))

    def of(keys: DataFrame, how: str) -> DataFrame:
        keys = broadcast_if_small(materialize(keys), 16)
        return marked.join(keys, marked["doc_id"].eqNullSafe(keys["doc_id"]) & (marked[digest] == keys["text_sha256"])
                           & (marked[size] == keys["n_chars"]), how)

    # The two key lists are disjoint, so rows that stand for one document are counted once.
    single = of(dropped.unionByName(repeated), "left_anti")
    return single.unionByName(of(repeated, "left_semi").dropDuplicates(["doc_id", digest])).drop(digest, size)
