"""The filter audit and the byte-level codec against brute force and the library."""

from __future__ import annotations

from hashlib import sha256
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablegauge.llm import audit, byte_codec
from tablegauge.llm.byte_codec import ByteCodec

FILE = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, source string, part string, bits string, n long, good string, digest int"
TEXTS = ["", None, "word " * 60, " ".join(f"w{i}" for i in range(55)), "ABC DEF", "a | b", " ".join(f"w{i}" for i in range(55)),
         "#" + " x" * 70, "X" * 40 + " " + " ".join(f"w{i}" for i in range(60)), "\t\n", "word " * 60, "a | b", "a | b"]


def rows():
    ids = [5, 4, 3, 9, 2, 8, 7, 1, None, 6, 10, 8, None]
    parts = ["x", None, "x", "y", "", "y", "x", "y", "x", "x", "z", "y", "x"]
    return [(i, t, p, "q", "r", 1, "s", 2) for i, t, p in zip(ids, TEXTS, parts)]


def brute(docs, labels):
    """Every filter of every document, every order, one document at a time."""
    docs = [(i, t or "", p or "") for i, t, p, *_ in docs]
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, t, p in docs:
        words = [w for w in t.encode().split()]
        fails.append({"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                      "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
                      "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)})
    out, shapley = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {p for *_, p in docs}:
            here = [(d, f) for d, f in zip(docs, fails) if d[2] == part]
            for k, name in enumerate(order):
                open_ = [(d, f) for d, f in here if not any(f[e] for e in order[:k])]
                gone = [d for d, f in open_ if f[name]]
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
                out[part, order, k + 1] = [len(open_) - len(gone), len(gone), sum(f[name] for _, f in here) - len(gone),
                                           sum(f[name] and sum(f.values()) == 1 for _, f in here),
                                           sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def test_audit_equals_brute_force(spark):
    labels = [(5, 1, 0), (5, 0, 1), (3, 0, 1), (2, 1, 1), (8, 1, None), (None, 1, 1), (77, 1, 1), (10, None, 1)]
    docs = rows()
    frame = audit.filter_interactions(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = frame.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COLUMNS) for r in found}
    assert len(found) == len(got) == 4 * 600
    assert got == brute(docs, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_interactions(docs, labels).count() == 0
    one = audit.filter_interactions(spark.createDataFrame(rows()[:3], DOC), labels).collect()
    assert len(one) == 1200 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in one)


def test_contraction_selects_along_axes():
    tensor = np.random.default_rng(1).integers(0, 9, (2, 2, 2, 2))
    assert (audit.contract(tensor, audit.PASS, audit.FAIL, audit.ALL) == tensor[:, 0, 1].sum(1)).all()


@pytest.fixture(scope="module")
def both():
    with open(FILE, encoding="utf-8") as source:
        return ByteCodec(source.read()), Tokenizer.from_file(FILE)


def library(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    return np.asarray(ids, dtype="<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "'re", " the", "ing", "aaaa", "  ", "\n\n", "\x1c", " ", "Ж", "中", "😀", "Ⅷ", "²"]),
                          st.text(max_size=8)), max_size=8).map("".join))
def test_codec_equals_library(both, text):
    mine, theirs = both
    ids, decoded = library(theirs, text)
    assert mine.encode(text) == ids
    assert mine.decode(ids) == decoded == text.encode()


def test_codec_knows_every_class(both):
    mine, _ = both
    for c in byte_codec.KNOWN:
        for text in (f"a{c}b", f"1{c}2", f"! {c}!{c}", f"{c} ", f"'{c}"):
            assert byte_codec.WORDS.findall(text) == [text[a:b] for _, (a, b) in mine.split(text)], hex(ord(c))


def test_broken_bytes_decode_as_in_library(both):
    mine, theirs = both
    rng = np.random.default_rng(5)
    for _ in range(400):
        ids = rng.integers(0, 50257, 6).astype("<u4")
        assert mine.decode(ids.tobytes()) == theirs.decode(ids.tolist(), skip_special_tokens=False).encode()


def test_every_token_is_its_own_encoding_or_left_out(both):
    mine, theirs = both
    rng = np.random.default_rng(7)
    for i in rng.integers(0, 50256, 800).tolist():
        stands = mine.made[i] == -1 or mine._stands(i)
        try:
            text = mine.plain[i].decode()
        except UnicodeDecodeError:
            continue
        words = byte_codec.WORDS.findall(text)
        if len(words) == 1 and not byte_codec.STRANGE.search(text):
            assert stands == (theirs.encode(text).ids == [i])


def test_small_memory_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(byte_codec, "CACHE_WORDS", 3)
    monkeypatch.setattr(byte_codec, "CACHE_PAIRS", 3)
    own, theirs = both
    mine = ByteCodec.__new__(ByteCodec)
    mine.__dict__ = own.__dict__ | {"words": {}, "older": {}, "pairs": {}}
    text = "The theatre is there, and then the other things were gathered together. " * 3
    assert mine.encode(text) == library(theirs, text)[0]


def test_round_trip_over_rows(spark, both):
    texts = ["", None, "one two", "one two", "x" * 50_000, "é " * 20_000, "<|endoftext|>", "0" * 3000, " " * 5000 + "a"]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in byte_codec.round_trip(docs, FILE).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, (ids, decoded) = got[i if i != 3 else None], library(both[1], t or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha256(ids).hexdigest(), sha256(decoded).hexdigest())
    assert byte_codec.round_trip(docs.limit(0), FILE).count() == 0
    coded = byte_codec.encode(docs, FILE)
    assert {r["doc_id"]: r["text"] for r in byte_codec.decode(coded, FILE).collect()} == {
        i if i != 3 else None: t or "" for i, t in enumerate(texts)}
