"""Ranked lexical search: best-first over document intervals bounded by range maxima."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.llm.common import id_and_text
from tablegauge.session import materialize

TOP = 10
#: Terms of the items that are searched together, and postings of one segment of documents.
BLOCK_TERMS, SEGMENT_POSTINGS = 200_000, 1_000_000
#: Intervals of an item that are split in one round.
BATCH = 48
#: Bytes of terms: digits, letters (A-Z as a-z) and all beyond ASCII; the others part terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split()


# --- one segment -------------------------------------------------------------------------


class SegmentIndex:
    """Posting lists of some documents, each under a sparse table of range maxima.

    ``doc``, ``term``, ``impact``: postings, an impact being what one occurrence of the term in a
    query adds to the document's score.  Documents are numbers from 0 on.
    """

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        order = np.lexsort((doc, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order].astype(np.int32), impact[order]
        self.keys = term[order].astype(np.int64) * n_docs + self.doc
        self.ends = np.searchsorted(self.keys, np.arange(n_terms + 1, dtype=np.int64) * n_docs)
        longest = int(np.diff(self.ends).max(initial=1))
        # Level j holds the place of the maximum of 2 ** j postings; a range never leaves its list.
        level = np.arange(len(order), dtype=np.int32)
        self.table, width = [level], 1
        while 2 * width <= longest:
            a, b = level[:-width], level[width:]
            level = level.copy()
            level[: len(a)] = np.where(self.impact[a] >= self.impact[b], a, b)
            self.table.append(level)
            width *= 2
        self.table = np.stack(self.table)

    def highest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the largest impact of each range ``lo <= place < hi``, none of them empty."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        a, b = self.table[level, lo], self.table[level, hi - (1 << level)]
        return np.where(self.impact[a] >= self.impact[b], a, b)

    def place(self, at: np.ndarray, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The first place in the lists of ``term`` at or behind ``doc``."""
        return np.searchsorted(self.keys, term * self.n_docs + doc).astype(at.dtype)


@dataclass
class Intervals:
    """Document intervals of items: bound, item, where to split, and for each the ranges of the
    item's posting lists that are not empty in it."""

    bound: np.ndarray
    item: np.ndarray
    split: np.ndarray
    size: np.ndarray                      # ranges of each interval
    term: np.ndarray                      # per range, as the following
    times: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def joined(self, other: Intervals) -> Intervals:
        return Intervals(*[np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.__dataclass_fields__])


def _bounded(index: SegmentIndex, item: np.ndarray, owner: np.ndarray, term: np.ndarray, times: np.ndarray,
             lo: np.ndarray, hi: np.ndarray) -> Intervals:
    """Intervals from ranges, ``owner`` being the interval of each range, in order.

    The bound sums the largest impacts of all ranges; the interval will be split at the document
    that holds the largest of them.
    """
    size = np.bincount(owner, minlength=len(item))
    item, size = item[size > 0], size[size > 0]
    if not len(size):
        nothing = np.zeros(0, dtype=np.int64)
        return Intervals(nothing, item, nothing.astype(np.int32), size, term, times, lo, hi)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = index.highest(lo, hi)
    adds = times * index.impact[at]
    most = np.repeat(np.maximum.reduceat(adds, first), size)
    # Of several ranges with the largest impact the first one's document.
    places = np.where(adds == most, np.arange(len(adds)), len(adds))
    split = index.doc[at[np.minimum.reduceat(places, first)]]
    return Intervals(np.add.reduceat(adds, first), item, split, size, term, times, lo, hi)


def _split(index: SegmentIndex, some: Intervals) -> tuple[np.ndarray, Intervals]:
    """The scores of the documents at which intervals are split, and the intervals left and right."""
    owner = np.repeat(np.arange(len(some.size)), some.size)
    doc = some.split[owner]
    cut = index.place(some.lo, some.term, doc)
    inside = cut < some.hi
    held = inside & (index.doc[np.where(inside, cut, 0)] == doc)
    adds = np.where(held, some.times * index.impact[np.where(held, cut, 0)], 0)
    score = np.add.reduceat(adds, np.concatenate([[0], np.cumsum(some.size)[:-1]]))
    left, right = some.lo < cut, cut + held < some.hi
    children = _bounded(
        index, np.concatenate([some.item, some.item]), np.concatenate([owner[left], owner[right] + len(some.size)]),
        np.concatenate([some.term[left], some.term[right]]), np.concatenate([some.times[left], some.times[right]]),
        np.concatenate([some.lo[left], (cut + held)[right]]), np.concatenate([cut[left], some.hi[right]]))
    return score, children


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of each item: highest score, then lowest document."""
    order = np.lexsort((doc, -score, item))
    mine = item[order]
    first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(mine) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(mine)) - np.repeat(first, np.diff(np.append(first, len(mine))))
    return order[rank < top]


def search(index: SegmentIndex, queries: list[tuple[np.ndarray, np.ndarray]], top: int = TOP, batch: int = BATCH,
           least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(query, document, score)`` of the ``top`` documents of each query, and the intervals split.

    A query is its distinct terms and how often it holds each.  Every round splits the intervals
    with the highest bounds of every query; an interval goes when its bound is below the score of
    the query's last document so far, or below ``least`` (a score that is known to be reached
    elsewhere).  Equal scores go by the document's number, so equal bounds stay.
    """
    n = len(queries)
    item = np.repeat(np.arange(n), [len(t) for t, _ in queries])
    term = np.concatenate([np.asarray(t, dtype=np.int64) for t, _ in queries] or [np.zeros(0, dtype=np.int64)])
    times = np.concatenate([np.asarray(c, dtype=np.int64) for _, c in queries] or [np.zeros(0, dtype=np.int64)])
    lo, hi = index.ends[term], index.ends[term + 1]
    some = lo < hi
    left = _bounded(index, np.arange(n), item[some], term[some], times[some], lo[some], hi[some])
    floor = np.ones(n, dtype=np.int64) if least is None else np.maximum(least, 1)
    q = d = s = np.zeros(0, dtype=np.int64)
    n_split = 0
    while True:
        live = np.flatnonzero(left.bound >= floor[left.item])
        if not len(live):
            return q, d, s, n_split
        chosen = live[_best(left.item[live], left.bound[live], left.split[live], batch)]
        chosen.sort()
        waiting = np.zeros(len(left.bound), dtype=bool)
        waiting[live] = True
        waiting[chosen] = False
        taken = _masked(left, chosen)
        n_split += len(chosen)
        score, children = _split(index, taken)
        q, d, s = np.concatenate([q, taken.item]), np.concatenate([d, taken.split]), np.concatenate([s, score])
        good = np.flatnonzero(s >= floor[q])
        q, d, s = q[good], d[good], s[good]
        kept = _best(q, s, d, top)
        q, d, s = q[kept], d[kept], s[kept]
        full = np.bincount(q, minlength=n) >= top
        worst = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(worst, q, s)
        floor = np.where(full, np.maximum(floor, worst), floor)
        children = _masked(children, np.flatnonzero(children.bound >= floor[children.item]))
        left = _masked(left, np.flatnonzero(waiting)).joined(children)


def _masked(all_: Intervals, chosen: np.ndarray) -> Intervals:
    """The ``chosen`` intervals (in order) with their ranges."""
    keep = np.zeros(len(all_.size), dtype=bool)
    keep[chosen] = True
    ranges = np.repeat(keep, all_.size)
    return Intervals(all_.bound[keep], all_.item[keep], all_.split[keep], all_.size[keep],
                     all_.term[ranges], all_.times[ranges], all_.lo[ranges], all_.hi[ranges])


# --- documents as rows of postings -------------------------------------------------------

ROWS = "doc_id bigint, n bigint, terms array<int>, times array<int>"


def _postings(texts: list[str | None], numbers: dict[bytes, int]) -> tuple[list, list, list]:
    """Per text: its number of terms, the numbers of the asked terms in it, and how often it holds each."""
    n, which, times = [], [], []
    for text in texts:
        words = terms(text or "")
        found = Counter(numbers[w] for w in words if w in numbers)
        n.append(len(words))
        which.append(list(found))
        times.append(list(found.values()))
    return n, which, times


def document_rows(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``row, doc_id, n, terms, times``: every document with the asked terms it holds, written once."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                n, which, times = _postings(some.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                    ["doc_id", "n", "terms", "times"])

    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(read, ROWS)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


@dataclass
class Weights:
    """What a score needs from all documents; as long as the asked terms of a block."""

    n_docs: int
    n_terms: int
    of_term: np.ndarray

    def impacts(self, term: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What one occurrence of ``term`` in an item adds for a document of ``length`` terms that holds it ``times``."""
        m = 100 - 75 + (75 * length * self.n_docs) // self.n_terms
        return self.of_term[term] * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def weights(rows: DataFrame, n_asked: int) -> Weights:
    """Counts over all documents: how many hold a term, how many hold each asked one, terms in all."""
    totals = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs = totals["docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_asked, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=n_asked)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    of_term = np.zeros(n_asked, dtype=np.int64)
    # One row per asked term of the block.
    for r in rows.select("terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        of_term[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return Weights(n_docs, totals["terms"] or 0, of_term)


def _one_per_class(n: np.ndarray, ends: np.ndarray, which: np.ndarray, times: np.ndarray, rank: np.ndarray, top: int) -> np.ndarray:
    """The documents that can be listed: of documents with equal counts the ``top`` first."""
    seen: Counter = Counter()
    kept = np.zeros(len(n), dtype=bool)
    for i in np.argsort(rank, kind="stable").tolist():
        a, b = ends[i], ends[i + 1]
        order = np.argsort(which[a:b])
        key = (int(n[i]), which[a:b][order].tobytes(), times[a:b][order].tobytes())
        seen[key] += 1
        kept[i] = seen[key] <= top
    return kept


FOUND = "item int, doc_id bigint, score bigint, n_split bigint"


def search_segment(table: pa.Table, queries: list[tuple[np.ndarray, np.ndarray]], known: Weights, top: int,
                   least: np.ndarray | None) -> pa.Table:
    """The best documents of one segment for every query.

    Documents are numbered by id, null ids last, so that equal scores go by id.  Copies beyond the
    ``top`` first of documents with equal counts have equal scores for all items and cannot be
    listed.
    """
    ids = table.column("doc_id").combine_chunks()
    rank = np.empty(len(ids), dtype=np.int64)
    order = np.asarray(pa.compute.sort_indices(ids, null_placement="at_end"))
    rank[order] = np.arange(len(ids))
    lists = table.column("terms").combine_chunks()
    sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    which = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    times = table.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = table.column("n").to_numpy()
    kept = _one_per_class(n, np.append(0, np.cumsum(sizes)), which, times, rank, top)
    mine = np.repeat(kept, sizes)
    doc, which, times = np.repeat(rank, sizes)[mine], which[mine], times[mine]
    impact = known.impacts(which, times, np.repeat(n, sizes)[mine])
    # Terms that all documents hold weigh nothing and cannot help a document.
    some = impact > 0
    index = SegmentIndex(len(ids), len(known.of_term), doc[some], which[some], impact[some])
    item, found, score, n_split = search(index, queries, top, least=least)
    return pa.table({"item": pa.array(item.astype(np.int32)), "doc_id": ids.take(pa.array(order[found])), "score": pa.array(score),
                     "n_split": pa.array(np.full(len(item), n_split, dtype=np.int64))})


def _blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """``[(item_id, {term: times})]`` in blocks of about ``block_terms`` terms; only one block is on the driver."""
    block, size = [], 0
    for r in items.select("doc_id", "text").toLocalIterator():
        own = Counter(terms(r["text"]))
        if block and size + len(own) > block_terms:
            yield block
            block, size = [], 0
        block.append((r["doc_id"], own))
        size += len(own)
    if block:
        yield block


def _segments(rows: DataFrame, n_segments: int, first: int, last: int) -> DataFrame:
    """The rows of segments ``first <= segment < last``, a segment being dealt by row numbers."""
    segment = F.pmod(F.xxhash64("row"), F.lit(n_segments)).cast("int")
    return rows.where(F.size("terms") > 0).withColumn("segment", segment).where(F.col("segment").between(first, last - 1))


def _search_block(docs: DataFrame, block: list[tuple], top: int, segment_postings: int) -> DataFrame:
    spark = docs.sparkSession
    numbers = {term: i for i, term in enumerate(sorted({term for _, own in block for term in own}))}
    rows = document_rows(docs, numbers)
    queries = [(np.array([numbers[t] for t in own], dtype=np.int64), np.array(list(own.values()), dtype=np.int64)) for _, own in block]
    shared = spark.sparkContext.broadcast((queries, weights(rows, len(numbers))))
    n_postings = rows.agg(F.sum(F.size("terms").cast("bigint"))).first()[0] or 0
    n_segments = max(1, -(-n_postings // segment_postings))
    # An eighth of the segments first: the scores that their documents reach bound all others.
    early = -(-n_segments // 8)

    def searched(first: int, last: int, least: np.ndarray | None) -> DataFrame:
        floor = spark.sparkContext.broadcast(least)

        def run(table: pa.Table) -> pa.Table:
            return search_segment(table, *shared.value, top, floor.value)

        dealt = _segments(rows, n_segments, first, last).repartition(last - first, "segment")
        return materialize(dealt.groupBy("segment").applyInArrow(run, FOUND))

    found = searched(0, early, None)
    if early < n_segments:
        # A number per item of the block.
        least = np.zeros(len(block), dtype=np.int64)
        ranked = _ranked(found, top).where(F.col("rank") == top)
        for r in ranked.select("item", "score").collect():
            least[r["item"]] = r["score"]
        found = found.unionByName(searched(early, n_segments, least))
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
    # The block's items, no more than its terms are.
    return _ranked(found, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, item_column: str = "item_id", text_column: str = "text",
                  block_terms: int = BLOCK_TERMS, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents (``doc_id, text``) of every item.

    Documents are counted once; those that hold an asked term are dealt into segments of bounded
    size.  Each segment has a posting list per term under a sparse table of range maxima.  An
    item starts with the interval of all documents of the segment; the sum of its terms' maxima
    bounds an interval.  The interval with the highest bound is split at the document that holds
    its largest impact, which is scored, until no bound reaches the last listed score.

    Null and empty texts hold no terms: such documents are never listed and not counted, such
    items have no rows, as items have whose terms no document holds.  Equal scores go by
    ascending ``doc_id``, null ids last.  Repeated rows are documents of their own; each row of
    ``items`` is an item of its own, also with a null or repeated id.  Empty tables give no rows;
    other columns are ignored.
    """
    asked = id_and_text(items, item_column, text_column)
    found = None
    for block in _blocks(asked, block_terms):
        own = _search_block(docs, block, top, segment_postings)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found
