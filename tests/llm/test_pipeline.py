"""The stages on a small table, against brute force."""

import importlib.util
import random

import pytest

import __spark_entry__ as entry

pytest.importorskip("public_tokenizers")


def test_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline as pipeline

    clean = [(i, f"clean text number {i} " + " ".join(f"w{i}x{k}" for k in range(60)), "en", "s", None) for i in range(40)]
    copies = [(100, clean[0][1] + " ", "en", "s", 1), (101, clean[1][1], "en", "s", 1), (101, clean[1][1], "en", "s", 1)]
    close = [(102, clean[2][1].replace("w2x59", "other"), "en", "s", 1)]
    leak = [(103, "here password = 'abcdefgh12' stands", "en", "s", 35), (None, None, None, None, None)]
    docs = spark.createDataFrame(clean + copies + close + leak, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, counts = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        counts[name] = sorted((r["doc_id"] for r in at.collect()), key=str)
    assert len(counts["toxicity"]) == 46
    ids = lambda *drop: sorted([i for i in [*range(40), 100, 101, 102, 103, None] if i not in drop], key=str)
    # The longer text stays, then the smaller id.
    assert counts["exact dedup"] == ids(0, 101)
    assert counts["near dedup"] == counts["secret scans"] == ids(0, 101, 102)
    leaked = at.where("doc_id = 103").first()
    assert leaked["text"] == "here <secret>' stands" and leaked["n_chars"] == len(leaked["text"])
    packed = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(counts["secret scans"])


def test_entry_registers_every_operator():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert importlib.util.find_spec("tablegauge.llm")


def tables(spark, tmp_path, docs, labels=((0, 1, 0),)):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sf_dir = tables(spark, tmp_path, docs)
    for _, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.count() == 0
    assert pipeline.run(spark, sf_dir).count() == 0


def test_stages_keep_clashing_columns_and_very_long_texts(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id bigint, text string, blob string, gone string, digest int, n_chars bigint, features string, row bigint, key string"
    rng = random.Random(2)
    vocabulary = [a + b + c for a in ("stone", "river", "cloud", "north") for b in ("and", "of", "to", "by") for c in "abcdefghijklm"]
    long_text = " ".join(rng.choices(vocabulary, k=620_000))[:5_000_000]
    rows = [(i, f"clean number {i} " + " ".join(f"x{i}y{k}" for k in range(50)), "b", "g", 3, 9, "f", 4, "k") for i in range(20)]
    rows += [(50, long_text, "b", "g", 3, 9, "f", 4, "k"), (51, "see token: abcdef1234", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    sf_dir, at = tables(spark, tmp_path, docs), docs
    for _, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
    kept = {r["doc_id"]: r for r in at.collect()}
    assert set(kept) == {*range(20), 50, 51} and kept[50]["text"] == long_text and len(long_text) == 5_000_000
    assert kept[51]["text"] == "see <secret>" and kept[7]["blob"] == "b" and kept[7]["digest"] == 3
    pieces = pipeline.run(spark, sf_dir).where("doc_id = 50").select("start", "length").collect()
    assert len(pieces) > 500 and sum(r["length"] for r in pieces) == max(r["start"] + r["length"] for r in pieces)
