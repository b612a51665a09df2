"""How filters act on each other: counts per set of failed filters, contracted along every order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import fresh
from tablegauge.session import materialize

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SIGNS = "[#$%&*|]"
#: Copies of each label row, so that rows of one id meet it in as many tasks.
SALTS = 8
#: Parts contracted together.
PARTS_AT_ONCE = 100
#: Every count that travels with the failure pattern: all documents, good ones, toxic ones.
MEASURES = ("n", "good", "toxic")


# --- failure patterns --------------------------------------------------------------------


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def own_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one text only: name -> true where it fails."""
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n_words < LEAST_WORDS,
            "B": F.lit(100) * n_distinct < DISTINCT_PERCENT * n_words,
            "C": F.lit(100) * capitals.cast("bigint") > CAPITAL_PERCENT * F.char_length(text),
            "D": text.rlike(SIGNS)}


def failure_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """``doc_id, part, bits, digest, n``: one row per distinct (id, text, part), with its number of rows.

    Bit i of ``bits`` is set where filter i of A to D fails.  Equal rows are counted before
    anything is shuffled, and the key holds both id and text: neither a common id nor a common
    text gathers in one task.
    """
    text = F.col("text")
    own = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # The words are a column of their own, so that they are split once.
    failures = own_failures(text, F.col("words")).values()
    bits = sum((F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(failures)), F.lit(0))
    rows = own.select("*", words_of(text).alias("words")).select(
        "doc_id", "part", bits.cast("int").alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"))
    return rows.groupBy("doc_id", "part", "bits", "digest").agg(F.count(F.lit(1)).alias("n"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with booleans ``good`` and ``toxic``; false for ids without a label row.

    Of several label rows of an id one that says 1 is enough.
    """
    known = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    salted = known.where("good OR toxic").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A null id meets no label: its rows are dealt by their digest only.
    found = rows.withColumn("salt", F.pmod(F.hash("digest", "part"), F.lit(SALTS))).withColumn(
        "id", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.hex("digest"))))
    salted = salted.withColumn("id", F.col("doc_id").cast("string")).drop("doc_id")
    # The optimizer sizes the copies by the small file of labels, so a broadcast is ruled out.
    return found.hint("merge").join(salted, ["id", "salt"], "left").select(
        *rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def pattern_counts(labelled: DataFrame) -> DataFrame:
    """``part, bits, n, good, toxic``: documents of each part by all five failure bits.

    A document fails E if its text is that of a smaller id.  So of the rows of a text those with
    its least id pass and all others fail; per group of rows alike the number with the group's
    least id is kept, and the least of all groups says which group's rows these are.  A null
    id is not larger than any other: its rows never fail E.
    """
    # (doc_id, digest, part) has one row here, so the least struct holds the count at the least id.
    # It is written, as it is read twice: without that the texts would be.
    alike = materialize(labelled.groupBy("digest", "bits", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")))
    least = alike.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.count(F.lit(1)).alias("groups"))
    # A text of one group is its own least id; only the others have to be told.
    told = alike.join(least.where("groups > 1").select("digest", "least"), "digest", "left")
    passed = F.col("n_null") + F.when(F.coalesce(F.col("least") == F.col("first.doc_id"), F.lit(True)),
                                      F.coalesce("first.n", F.lit(0))).otherwise(F.lit(0))
    split = told.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("bits"), passed.alias("n")),
        F.struct((F.col("bits") + F.lit(1 << 4)).alias("bits"), (F.col("n") - passed).alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.where("x.n > 0").groupBy("part", F.col("x.bits").alias("bits")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(F.lit(0))).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(F.lit(0))).alias("toxic"))


# --- contractions ------------------------------------------------------------------------

#: What an axis (0 passes, 1 fails) is multiplied with.
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def contract(tensor: np.ndarray, *axes: np.ndarray) -> np.ndarray:
    """Counts ``(..., 2, 2, ...)`` summed over what each axis selects."""
    letters = "abcdefghijklmnopqrstuvwxyz"[: len(axes)]
    return np.einsum(f"...{letters},{','.join(letters)}->...", tensor, *axes)


def audit_orders(tensor: np.ndarray, names: str = FILTERS) -> list[tuple[str, int, np.ndarray]]:
    """``(order, step, values)`` for every order of the filters.

    ``tensor`` is (parts, measures, 2, ..., 2), an axis per filter; ``values`` is (parts, 7):
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    k, found = len(names), []
    removed_by = np.zeros((k, len(tensor)), dtype=np.int64)
    alone = [contract(tensor[:, 0], *[FAIL if j == i else PASS for j in range(k)]) for i in range(k)]
    failed = [contract(tensor[:, 0], *[FAIL if j == i else ALL for j in range(k)]) for i in range(k)]
    for order in permutations(range(k)):
        axes = [ALL] * k
        for step, i in enumerate(order, 1):
            axes[i] = FAIL                      # earlier filters pass, this one fails, later ones are open
            gone = contract(tensor, *axes)
            axes[i] = PASS
            kept = contract(tensor[:, 0], *axes)
            removed_by[i] += gone[:, 0]
            found.append((order, step, i, np.stack([kept, gone[:, 0], failed[i] - gone[:, 0], alone[i], gone[:, 1], gone[:, 2]], 1)))
    return [("".join(names[i] for i in order), step, np.column_stack([values, removed_by[i]]))
            for order, step, i, values in found]


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shape = [len(MEASURES), *[2] * len(FILTERS)]
    for batch in batches:
        for at in range(0, len(batch), PARTS_AT_ONCE):
            some = batch.iloc[at: at + PARTS_AT_ONCE]
            # Bit i is axis i: the last axis of a reshaped row runs fastest, so axes are turned round.
            tensor = np.array([np.stack(list(c)) for c in some["counts"]], dtype=np.int64).reshape(len(some), *shape)
            tensor = tensor.transpose(0, 1, *range(1 + len(FILTERS), 1, -1))
            names, steps, values = zip(*audit_orders(tensor))
            yield pd.DataFrame({"part": np.tile(some["part"].to_numpy(), len(names)), "filter_order": np.repeat(names, len(some)),
                                "step": np.repeat(np.array(steps, dtype=np.int32), len(some)),
                                **dict(zip(COLUMNS, np.concatenate(values).T))})


def filter_interactions(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        part_column: str = "source") -> DataFrame:
    """One row per part, order of the five filters, and step, with seven counts of documents.

    Spark counts the documents of each part by the set of filters they fail; each part's counts,
    as a 2x2x2x2x2 tensor, are contracted for every step of every order.

    A null text is empty, a null part is the part ``''``.  A null id is no smaller and no larger
    than another and has no label.  Repeated rows count each; of equal ids none is smaller.
    Empty tables give no rows; columns other than id, text and part are not read.
    """
    ids, parts, texts = fresh(docs, "audit_id", "audit_part", "audit_text")
    own = docs.select(F.col(id_column).alias(ids), F.col(part_column).alias(parts), F.col(text_column).alias(texts))
    counts = pattern_counts(with_labels(failure_rows(own, ids, texts, parts), labels))
    size = 1 << len(FILTERS)
    # 32 patterns at most: one row of three short arrays per part.
    by_pattern = lambda m: F.array(*[F.coalesce(F.sum(F.when(F.col("bits") == b, F.col(m))), F.lit(0)) for b in range(size)])
    tensors = counts.groupBy("part").agg(F.array(*[by_pattern(m) for m in MEASURES]).alias("counts"))
    return tensors.mapInPandas(_audit, "part string, filter_order string, step int, "
                               + ", ".join(f"{c} bigint" for c in COLUMNS))
