"""Ranked lexical search against a scan of all documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablegauge.llm import lexical

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOC = "doc_id long, text string, item_id int, rank string, score string, segment int, row int, n int"
ITEM = "item_id long, text string, doc_id string"


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, scores = words(text), []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in asked if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    pool = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "x1", "Zz")]
    docs = [(i, " ".join(rng.choices(pool, weights=range(1, 33), k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, "copy of the same text") for i in range(40)] + [(7, docs[7][1])] * 3
    docs += [(None, "copy of the same text"), (None, "a-b_c"), (2000, ""), (2001, None), (2002, " .,;"), (2003, "same " * 20_000), (2004, "AÉ aé")]
    items = [(1, "Copy of the SAME text"), (2, "a aé bx1"), (3, ""), (4, None), (5, "unknown words"), (6, docs[5][1]), (6, docs[6][1]),
             (None, "same same same copy"), (9, " ".join(pool * 3))]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1, "r", "s", 2, 3, 4) for i, t in docs], DOC),
            spark.createDataFrame([(i, t, "d") for i, t in items], ITEM))


@pytest.mark.parametrize("size", [{}, {"segment_postings": 700}, {"segment_postings": 2500, "block_terms": 12}])
def test_search_equals_scan(spark, size):
    docs, items = corpus()
    found = lexical.ranked_search(*frames(spark, docs, items), **size).collect()
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found), key=repr)
    assert got == brute(docs, items)


def test_search_of_nothing(spark):
    docs, items = frames(spark, *corpus())
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_top_is_a_parameter(spark):
    docs, items = corpus()
    got = lexical.ranked_search(*frames(spark, docs, items), top=3, segment_postings=1500).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr) == brute(docs, items, 3)


def random_index(seed, n_docs=300, n_terms=40, n_postings=3000):
    rng = np.random.default_rng(seed)
    pair = np.unique(rng.integers(0, n_docs * n_terms, n_postings))
    return pair // n_terms, pair % n_terms, rng.integers(1, 1000, len(pair)), n_docs, n_terms


def test_range_maxima():
    doc, term, impact, n_docs, n_terms = random_index(1)
    index = lexical.SegmentIndex(n_docs, n_terms, doc, term, impact)
    rng = np.random.default_rng(2)
    for t in range(n_terms):
        a, b = index.ends[t], index.ends[t + 1]
        for _ in range(30):
            lo, hi = sorted(rng.integers(a, b + 1, 2).tolist())
            if lo < hi:
                at = index.highest(np.array([lo]), np.array([hi]))[0]
                assert lo <= at < hi and index.impact[at] == index.impact[lo:hi].max()


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_search_splits_few_intervals_and_loses_nothing(batch):
    doc, term, impact, n_docs, n_terms = random_index(3)
    impact[doc < 12] += 3000                      # a few documents stand out: the rest is bounded away
    index = lexical.SegmentIndex(n_docs, n_terms, doc, term, impact)
    queries = [(np.arange(k, k + 5), np.array([1, 2, 1, 1, 3])) for k in range(0, 30, 3)]
    q, d, s, n_split = lexical.search(index, queries, batch=batch)
    for k, (which, times) in enumerate(queries):
        total = np.zeros(n_docs, dtype=np.int64)
        for t, c in zip(which, times):
            np.add.at(total, doc[term == t], c * impact[term == t])
        best = np.lexsort((np.arange(n_docs), -total))[:10]
        mine = np.flatnonzero(q == k)
        mine = mine[np.lexsort((d[mine], -s[mine]))]
        assert d[mine].tolist() == best.tolist() and s[mine].tolist() == total[best].tolist()
    if batch < 1000:
        assert n_split < len(queries) * n_docs / 3
    floor = np.full(len(queries), 10**9)
    assert not len(lexical.search(index, queries, least=floor)[0])
