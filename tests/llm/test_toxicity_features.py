"""What toxicity learns from covering, and what it leaves alone."""

from __future__ import annotations

import random
from collections import Counter

from tablegauge.llm import toxicity
from tablegauge.llm.toxicity import ToxicRow, cover, distinct_rows, features

CLEAN = "the path through forest is worth walk words antwort case was path worthy trashing".split()


def test_stems_that_longer_words_explain_are_dropped():
    rows = [frozenset(f for w in ("pathetic", "worthless", f"x{i}") for f in features(w)) for i in range(60)]
    weights, _ = cover(rows, Counter(), 500)
    assert "pathetic " in weights and not {"path", "pathe", "pathet", "wort", "worth"} & set(weights)
    found = lambda w: set(features(w)) & set(weights)
    assert not found("path") and not found("pathological") and not found("wortschatz") and found("worthless")


def test_a_sure_word_keeps_its_endings():
    rows = [frozenset(f for w in (["idiot"] if i % 2 else ["idiots"]) for f in features(w)) for i in range(80)]
    weights, _ = cover(rows, Counter(), 500)
    assert {"idiot ", "idiot"} <= set(weights) and "idio" not in weights
    assert set(features("idiotic")) & set(weights)


def test_copies_count_once():
    one, two = (frozenset({"a"}), frozenset({"b"}))
    rows = [ToxicRow("p", (1, 2, 3, 4), one), ToxicRow("p", (1, 2, 3, 5), one), ToxicRow("q", (7, 8, 9, 5), two)]
    assert distinct_rows(rows) == [one, two] == distinct_rows(rows[::-1])


def test_clean_words_that_begin_like_toxic_ones_pass(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = rng.choices(CLEAN, k=8) + ["".join(rng.choices("abdeilmnorstu", k=6)) for _ in range(25)]
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(3, rng.choice(["pathetic", "worthless"] * 10 + ["w0rthless", "p@thetic"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    frame = spark.createDataFrame(docs + [(1000, "A pathological case, worth a path."), (1001, None), (1002, "you are p4thetic")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[1000] < 0.1 and got[1001] < 0.1 and got[1002] > 0.9
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(600))
