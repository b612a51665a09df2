"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import SPACES, id_and_text, without

SYMBOLS = "#*$%&|<>"
#: Common short words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that for with was der die und das von den mit ist ein eine "
              "le la les de des et en un une que el los y del se por con una").split()


@dataclass(frozen=True)
class Rule:
    """``low <= number / per <= high``, both bounds in thousandths; a bound of None is open."""

    name: str
    number: str
    per: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        scaled = F.lit(1000) * F.col(self.number).cast("bigint")
        held = F.lit(True)
        if self.low is not None:
            held = held & (scaled >= self.low * F.col(self.per).cast("bigint"))
        if self.high is not None:
            held = held & (scaled <= self.high * F.col(self.per).cast("bigint"))
        return held


RULES = (
    Rule("mean word length", "word_chars", "n_words", low=2000, high=12000),
    Rule("symbols per word", "n_symbols", "n_words", high=100),
    Rule("stop words per word", "n_stop_words", "n_words", low=20),
    Rule("words with a letter", "n_letter_words", "n_words", low=800),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=300),
    Rule("lines with a final ellipsis", "n_ellipsis_lines", "n_lines", high=300),
    Rule("lines with a bullet", "n_bullet_lines", "n_lines", high=900),
)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with the counts that rules can name.

    A null text has no words and all counts 0.  Everything is a built-in expression; no row
    leaves its task.
    """
    space = r"[\x20\x09-\x0D]"
    rows = id_and_text(docs, id_column, text_column)
    words = rows.select(
        "doc_id", "text",
        F.expr(rf"filter(split(text, r'{space}+'), w -> w <> '')").alias("words"),
        F.expr(rf"filter(split(text, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')").alias("lines"))
    windows = words.select(
        "*", F.size("words").cast("bigint").alias("n_words"), F.size("lines").cast("bigint").alias("n_lines"),
        F.expr("""transform(slice(words, 1, greatest(size(words) - 2, 0)),
                            (w, i) -> concat_ws(' ', w, words[i + 1], words[i + 2]))""").alias("windows"))
    # Windows are sorted with their places only where one occurs twice.
    repeated = windows.select("*", F.expr("""
        CASE WHEN size(array_distinct(windows)) < size(windows)
             THEN array_sort(transform(windows, (w, i) -> struct(w AS w, i AS i)))
             ELSE cast(array() AS array<struct<w: string, i: int>>) END""").alias("sorted")).drop("windows")
    places = repeated.select("*", F.expr("""
        array_sort(transform(filter(sorted, (x, j) -> (j > 0 AND sorted[greatest(j - 1, 0)].w = x.w)
                                                   OR (j < size(sorted) - 1 AND sorted[least(j + 1, size(sorted) - 1)].w = x.w)),
                             x -> x.i))""").alias("places")).drop("sorted")
    covered = F.expr("""
        CASE WHEN size(places) = 0 THEN 0L
             ELSE aggregate(transform(slice(places, 2, size(places)), (p, k) -> least(3, p - places[k])),
                            3L, (total, gap) -> total + gap) END""")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    count = lambda condition, of="lines", v="l": F.expr(f"size(filter({of}, {v} -> {condition}))").cast("bigint")
    return places.select(
        "doc_id", "n_words", "n_lines",
        F.char_length(without(F.col("text"), SPACES)).cast("bigint").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        count(f"lower(w) IN ({stop})", "words", "w").alias("n_stop_words"),
        count(r"w rlike r'\p{L}'", "words", "w").alias("n_letter_words"),
        count(r"l rlike r'(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'").alias("n_ellipsis_lines"),
        count(r"l rlike r'^[\x20\x09-\x0D]*[-*\x{2022}]'").alias("n_bullet_lines"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """The base counts of every document, ``base_failed``, ``kept`` and the name of the first broken rule.

    Base: fewer than 50 words, or more than half of them inside repeated 3-word windows, fails.
    Null and empty texts fail.  Rows are judged one by one, repeated rows alike; an empty table
    gives no rows; other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.coalesce(*[F.when(~r.holds(), F.lit(r.name)) for r in rules], F.lit(None).cast("string"))
    judged = statistics(docs, id_column, text_column).select("*", failed.alias("base_failed"), broken.alias("broken"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("broken").isNull()).alias("kept"), F.col("broken").alias("broken_rule"))
