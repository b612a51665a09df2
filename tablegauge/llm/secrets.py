"""Secret scans over a ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import fresh, id_and_text, pieces
from tablegauge.session import broadcast_if_small, materialize, path_exists, scratch_path

#: Raise it with every change of the rules: blobs scanned under another version are scanned again.
RULE_VERSION = "2"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*(?:[A-Za-z0-9-]+:[^\r\n]*\r?\n)*"
                 r"[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")

FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                     T.StructField("end", T.IntegerType())]))
LEDGER = "blob string, rule_version string, findings array<struct<kind: string, start: int, end: int>>"


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the order of ``KINDS``.

    Every kind is matched leftmost and without overlap; a match that is too short is dropped
    and what it covers is not tried again.
    """
    found: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", m.start(), m.end()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", m.start(), m.end()) for m in JWT.finditer(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in pieces(batch, ["text"]):
            yield pd.DataFrame({"blob": part["blob"].to_numpy(), "rule_version": RULE_VERSION, "findings": [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in part["text"]]})


def read_ledger(spark: SparkSession, path: str | None) -> DataFrame:
    """The findings of earlier runs; no path, or one to which nothing was appended, is an empty ledger."""
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(f"{LEDGER}, bucket string").parquet(path).drop("bucket")


def append_entries(entries: DataFrame, path: str) -> None:
    """Add ``entries`` to the ledger at ``path``; those that it holds already are left out.

    Folders by rule version and by the first digits of the blob: a run reads its own version only,
    and a step that is repeated after a loss adds nothing twice.
    """
    known = read_ledger(entries.sparkSession, path).select("blob", "rule_version")
    fresh_ = entries.dropDuplicates(["blob", "rule_version"]).join(known, ["blob", "rule_version"], "left_anti")
    (fresh_.withColumn("bucket", F.substring("blob", 1, 1)).repartition("rule_version", "bucket")
     .write.mode("append").partitionBy("rule_version", "bucket").parquet(path))


def scan_versions(versions: DataFrame, ledger: DataFrame, id_column: str = "doc_id",
                  text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan the versions whose content no ledger entry of this rule version covers.

    Returns ``(findings per version, new ledger entries)``: ``doc_id, blob, findings`` with one
    row per row of ``versions``, and rows to append to the ledger.  A blob is the SHA-256 of a
    text; of all versions that hold it one is scanned, whatever their paths.  Only ids and
    digests are compared with the ledger; texts travel to meet the list of versions to scan,
    unless that list is small enough to be sent to them.

    Null texts are empty and hold no secrets.  Ids may be null or repeated: an id with two
    contents is two versions.  Empty tables give empty results; other columns are ignored.
    """
    spark = versions.sparkSession
    rows = id_and_text(versions, id_column, text_column).withColumn("blob", F.sha2("text", 256))
    keys = materialize(rows.select("doc_id", "blob"))
    known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "findings").dropDuplicates(["blob"])
    unseen = keys.groupBy("blob").agg(F.min("doc_id").alias("first_id")).join(known.select("blob"), "blob", "left_anti")
    todo = materialize(unseen)
    # Null ids: min() skips them, so a blob with null ids only has a null first id.
    wanted = todo.select(F.col("blob").alias("_blob"), F.col("first_id").alias("_first"))
    texts = rows.join(broadcast_if_small(wanted, 8), F.col("doc_id").eqNullSafe(F.col("_first"))
                      & (F.col("blob") == F.col("_blob")), "left_semi").select("blob", "text")
    entries = spark.read.schema(LEDGER).parquet(_written(texts.mapInPandas(_scan, LEDGER)))
    entries = entries.dropDuplicates(["blob", "rule_version"])
    every = known.unionByName(entries.select("blob", "findings"))
    return keys.join(every, "blob").select("doc_id", "blob", "findings"), entries


def _written(entries: DataFrame) -> str:
    path = scratch_path(entries.sparkSession, "ledger")
    entries.write.parquet(path)
    return path


def span_digest(findings: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from findings."""
    count = lambda kind: F.expr(f"size(filter(findings, f -> f.kind = '{kind}'))").cast("bigint")
    listed = lambda of: F.expr(f"array_join(transform({of}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')")
    return findings.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(listed("filter(findings, f -> f.kind IN ('assign', 'access', 'hex'))"), 256).alias("base_sha256"),
        listed("findings").alias("spans"))


def redacted(text: str, spans: list[tuple[int, int]], mark: str = "<secret>") -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """All rows of ``docs``; the text of those with findings is masked and ``n_chars`` counted anew."""
    findings, _ = scan_versions(docs, ledger)
    blob, spans, hit_id, hit_blob = fresh(docs, "blob", "spans", "hit_id", "hit_blob")
    hits = materialize(findings.where(F.size("findings") > 0).select(
        F.col("doc_id").alias(hit_id), F.col("blob").alias(hit_blob), F.col("findings").alias(spans)).dropDuplicates([hit_id, hit_blob]))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, [(f["start"], f["end"]) for f in fs])
                          for t, fs in zip(texts, found)], dtype=object)

    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.withColumn(blob, F.sha2(text, 256)).join(
        broadcast_if_small(hits, 16), F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col(blob) == F.col(hit_blob)), "left")
    # Only texts with findings go through Python.
    masked = F.when(F.col(spans).isNotNull(), mask(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans)))
    out = joined.withColumn("text", F.coalesce(masked, F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
