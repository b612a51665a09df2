"""The ledger of secret scans: written, met again, and never doubled."""

from __future__ import annotations

import pytest

from tablegauge.llm import secrets

VERSIONS = "doc_id long, text string, blob string, bucket string, findings int"


def versions(spark, rows):
    return spark.createDataFrame([(i, t, "b", "c", 1) for i, t in rows], VERSIONS)


def spans(findings):
    return sorted(((r["doc_id"], r["spans"]) for r in secrets.span_digest(findings).collect()), key=str)


def test_a_written_ledger_is_met_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(i, f"token = secretvalue{i % 7}") for i in range(30)] + [(40, None), (None, ""), (41, "AKIA" + "Z9" * 9)]
    first, entries = secrets.scan_versions(versions(spark, rows[:12]), secrets.read_ledger(spark, path))
    secrets.append_entries(entries, path)
    secrets.append_entries(entries, path)                      # a step that is run again adds nothing
    assert secrets.read_ledger(spark, path).count() == 7
    every, more = secrets.scan_versions(versions(spark, rows), secrets.read_ledger(spark, path))
    assert more.count() == 2                                   # the empty text and the access key
    secrets.append_entries(more, path)
    alone, _ = secrets.scan_versions(versions(spark, rows), secrets.read_ledger(spark, None))
    assert spans(every) == spans(alone) and len(spans(every)) == len(rows)
    _, none = secrets.scan_versions(versions(spark, rows), secrets.read_ledger(spark, path))
    assert none.count() == 0


def test_another_rule_version_scans_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    _, entries = secrets.scan_versions(versions(spark, [(1, "token = abcdef")]), secrets.read_ledger(spark, path))
    secrets.append_entries(entries.selectExpr("blob", "'0' AS rule_version", "findings"), path)
    _, again = secrets.scan_versions(versions(spark, [(1, "token = abcdef")]), secrets.read_ledger(spark, path))
    assert again.count() == 1
    secrets.append_entries(again, path)
    assert sorted(r["rule_version"] for r in secrets.read_ledger(spark, path).collect()) == ["0", secrets.RULE_VERSION]


@pytest.mark.parametrize("head", ["", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"])
def test_private_keys_with_headers(head):
    text = f"x -----BEGIN RSA PRIVATE KEY-----\n{head}abcd+/=\nefgh\n-----END RSA PRIVATE KEY----- y"
    assert [f for f in secrets.find_secrets(text) if f[0] == "pem"] == [("pem", 2, len(text) - 2)]


def test_very_long_texts_stay_quick():
    text = "password: " * 200_000 + "-----BEGIN PRIVATE KEY-----\n" + "a: b\n" * 100_000
    assert all(k != "pem" for k, *_ in secrets.find_secrets(text))
