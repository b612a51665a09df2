"""Surrogates: permutations of shapes, distinct names, scripts and keys."""

from __future__ import annotations

import random
import re

import pytest

from tablegauge.llm import surrogates
from tablegauge.llm.surrogates import another, permuted, surrogate


@pytest.mark.parametrize("size", [1, 2, 3, 10, 26, 676, 1000])
def test_permutations_are_permutations_without_fixed_points(size):
    seen = [another(b"k", "shape", v, size) for v in range(size)]
    assert sorted(seen) == list(range(size))
    assert size == 1 or all(v != s for v, s in enumerate(seen))
    assert all(permuted(b"k", "s", permuted(b"k", "s", v, size), size, forward=False) == v for v in range(size))


def test_large_shapes():
    size = 26**400
    assert another(b"k", "s", 5, size) != another(b"k", "s", 6, size) < size


def test_a_full_shape_gets_other_values_in_one_pass(spark):
    """All 676 addresses of a shape occur: each gets another one."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    all_ = [f"{a}@{b}.co" for a in letters for b in letters]
    docs = spark.createDataFrame([(i, f"to {v} now") for i, v in enumerate(all_)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split()[1] for r in surrogates.replace_entities(docs, b"k").collect()}
    assert sorted(got.values()) == sorted(all_) and all(got[i] != v for i, v in enumerate(all_))


@pytest.mark.parametrize("text, script", [("Mr Γιώργος came", "greek"), ("господин Иванов", "cyrillic"), ("Mr Արամ came", "armenian"),
                                          ("Mr Smith came", "latin"), ("Frau Müller", "latin")])
def test_names_stay_in_their_script(text, script):
    (_, _, kind, value, *_), = surrogates.find_parts(text)
    new = surrogate(b"k", kind, value)
    assert surrogates.script_of(new) == surrogates.script_of(value[2:]) == script and new != value[2:]


def test_keys_change_surrogates():
    for kind, value in (("email", "jo@ex.com"), ("phone", "+1 555 123 4567"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("name", "m:Smith")):
        one, two = surrogate(b"one", kind, value), surrogate(b"two", kind, value)
        assert one != two and one != value and one == surrogate(b"one", kind, value)
        assert re.sub(r"\d", "0", one) == re.sub(r"\d", "0", value) or kind in ("email", "ip", "name")
    assert surrogates.luhn(re.sub(r"\D", "", surrogate(b"k", "card", "4111 1111 1111 1111")))


def test_shapes_never_meet():
    rng = random.Random(3)
    values = {("phone", f"{lead}{rng.randrange(10**6):06d}") for lead in ("+1 ", "+49 ", "0", "(0") for _ in range(300)}
    values |= {("ip", f"{rng.randrange(256)}.{rng.randrange(4)}.1.{rng.randrange(256)}") for _ in range(300)}
    new = [(k, surrogate(b"k", k, v)) for k, v in values]
    assert len(set(new)) == len(values) and not any(n == v for n, v in zip(new, values))


def test_equal_proposals_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "_syllables", lambda script, number, count: "bade")
    names = [f"m:{a}{b}" for a in ("Smith", "Brown", "Young") for b in ("", "er", "son")] + ["m:Baden", "f:Smith"]
    rows = spark.createDataFrame([(v, surrogate(b"k", "name", v)) for v in names], "value string, surrogate string")
    mine = {r["value"]: r["surrogate"] for r in rows.collect()}
    ranked = surrogates.told_apart(rows, b"k")
    # The patch does not reach the workers: give them the ranks instead.
    counts = ranked.count()
    assert counts == len(names) - 1              # all men propose the same, and one is named so; the woman is alone
    apart = [surrogate(b"k", "name", v, r) for r, v in enumerate(names[:-1], 1)]
    assert len(set(apart)) == len(apart) and "Baden" not in apart and mine["f:Smith"] not in apart


def test_distinctness_and_coreference_over_a_random_table(spark):
    rng = random.Random(9)
    men = ["".join(rng.choices("aeioubcdlmnrst", k=rng.randint(2, 9))).capitalize() for _ in range(400)]
    mails = [f"{rng.choice('abcd')}{rng.randrange(30)}@m{rng.randrange(3)}.org" for _ in range(300)]
    docs = [(i, f"Mr {rng.choice(men)} wrote to {rng.choice(mails)} from 10.0.{rng.randrange(4)}.{rng.randrange(9)}") for i in range(1500)]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(spark.createDataFrame(docs, "doc_id long, text string"), b"k").collect()}
    pattern = re.compile(r"Mr (\w+) wrote to (\S+) from (\S+)")
    for kind in (1, 2, 3):
        there = {(pattern.fullmatch(t)[kind], pattern.fullmatch(got[i])[kind]) for i, t in docs}
        assert len({a for a, _ in there}) == len({b for _, b in there}) == len(there)
        assert all(a != b for a, b in there)


def test_odd_rows_and_clashing_columns(spark):
    low = -(1 << 63)
    docs = spark.createDataFrame([(low, "Mr Smith", "x"), (None, "Mr Smith", "x"), (None, None, "x"), (0, "Mr Smith, " * 30_000, "x")],
                                 "doc_id long, text string, surrogate string")
    got = {(r["doc_id"], r["text"][:3]): r for r in surrogates.replace_entities(docs, b"k").collect()}
    assert set(got) == {(low, "Mr "), (None, "Mr "), (None, ""), (0, "Mr ")}
    assert got[0, "Mr "]["text"] == (got[low, "Mr "]["text"] + ", ") * 30_000 and "Smith" not in got[0, "Mr "]["text"]
    with pytest.raises(TypeError):
        surrogates.replace_entities(docs)
