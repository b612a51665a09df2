"""One query per text operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import audit, byte_codec, exact, lexical, near, packing, piece_codec, quality_model, quality_rules, secrets, suffixes, surrogates, toxicity
from tablegauge.llm.common import documents, labels, prepared
from tablegauge.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function
    return register


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(prepared(spark), sf_dir)).drop("runs")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(prepared(spark), sf_dir), labels(spark, sf_dir))


@query("op5_quality_model")
def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(documents(prepared(spark), sf_dir), labels(spark, sf_dir))


@query("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(prepared(spark), sf_dir))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(prepared(spark), sf_dir))


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(documents(prepared(spark), sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(prepared(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_exact_dedup")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(prepared(spark), sf_dir))


@query("op9_pii_surrogates")
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A query has to be repeatable: its key is no secret.
    return surrogates.replace_entities(documents(prepared(spark), sf_dir), key=b"op9 of the catalogue")


@query("op10_secret_scans")
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over a ledger: an earlier one over some of the versions, then one over all of them.

    The second run scans only what the first has not seen; its result covers every version.
    """
    versions, path = documents(prepared(spark), sf_dir), scratch_path(spark, "secrets")
    earlier = versions.where(F.xxhash64("doc_id") < 0)
    _, entries = secrets.scan_versions(earlier, secrets.read_ledger(spark, path))
    secrets.append_entries(entries, path)
    findings, entries = secrets.scan_versions(versions, secrets.read_ledger(spark, path))
    secrets.append_entries(entries, path)
    return secrets.span_digest(findings)


@query("op11_lexical_search")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(prepared(spark), sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_filter_audit")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_interactions(documents(prepared(spark), sf_dir), labels(spark, sf_dir))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_codec.round_trip(documents(prepared(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


ORACLES["op11_lexical_search"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM t),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
p AS (SELECT doc_id, term,
             floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact
      FROM tf JOIN df USING (term), g),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10"""

ORACLES["op12_filter_audit"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
             + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
o AS (SELECT '' AS filter_order, 0 AS used, 0 AS step
      UNION ALL SELECT filter_order || 'ABCDE'[i + 1], used + (1 << i), step + 1
      FROM o, range(5) r(i) WHERE (used >> i) & 1 = 0),
s AS (SELECT a.filter_order, k AS step, ascii(a.filter_order[k]) - 65 AS bit,
             coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(a.filter_order[j]) - 65))), 0)::INT AS earlier
      FROM (SELECT filter_order FROM o WHERE step = 5) a, range(1, 6) r(k)),
x AS (SELECT part, filter_order, step, bit,
             coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND (mask >> bit) & 1 = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND (mask >> bit) & 1 = 1), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE mask & earlier <> 0 AND (mask >> bit) & 1 = 1), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = 1 << bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND (mask >> bit) & 1 = 1), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE mask & earlier = 0 AND (mask >> bit) & 1 = 1), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x"""

ORACLES["op8_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body,
                  length(coalesce(text, '')) AS n_chars FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY body) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256, n_chars FROM w"""

ORACLES["op4_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS times FROM win),
cov AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM rep WHERE times > 1) GROUP BY doc_id),
s AS (SELECT doc_id, len(words) AS n_words, len(lines) AS n_lines,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(words, lambda x: list_contains([{stop}], lower(x)))) AS n_stop_words,
             len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
             len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{{2022}}]'))) AS n_bullet_lines
      FROM w LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE {cases} END AS broken_rule FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken_rule IS NULL AS kept, broken_rule FROM j"""


def _rule_cases() -> str:
    """WHEN branches that name the first broken rule; the thresholds are the operator's table."""
    branches = []
    for rule in quality_rules.RULES:
        if rule.low is not None:
            branches.append((f"1000 * {rule.number} < {rule.low} * {rule.per}", rule.name))
        if rule.high is not None:
            branches.append((f"1000 * {rule.number} > {rule.high} * {rule.per}", rule.name))
    return " ".join(f"WHEN {c} THEN '{n}'" for c, n in branches)


ORACLES["op4_quality_rules"] = ORACLES["op4_quality_rules"].format(
    stop=", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS), cases=_rule_cases())
