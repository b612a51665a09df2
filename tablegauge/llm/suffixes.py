"""Repeated passages: a sparse suffix sort with hash comparisons.

Every ``LENGTH``-byte window has a minimizer, the place of its least 32-byte gram hash.  Runs of
windows with one minimizer make a segment; equal windows lie at equal distances before equal
grams, so only segments under one gram can share a window.  Whole segments that recur are settled
by counting.  The segments of grams with different contents are sorted: suffixes at equal
distances are merge-sorted, comparisons find the common extension by binary search on prefix
hashes, and neighbours with a common extension of a whole window are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import id_and_text
from tablegauge.session import materialize

LENGTH, GRAM = 200, 32
#: Window starts that one pass over a long text takes.
BLOCK = 1 << 19
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Segments that share a sorting task, and of one gram that may meet in it.
SHARD_SEGMENTS, GROUP_SEGMENTS = 6_000, 2_000
_BITS = 20


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of every substring of a byte array, from prefix sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 0) -> None:
        self.up, self.down = self.powers(len(data) + 1, seed)
        table = _odd(256, 1000 + seed)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(table[data] * self.up[: len(data)], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        known = cls._powers.get(seed)
        if known is None or len(known[0]) < n:
            size = 1 << (n - 1).bit_length()
            base = int(_odd(1, 2000 + seed)[0])
            inverse = pow(base, -1, 1 << 64)
            known = cls._powers[seed] = tuple(
                np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]).astype(np.uint64).cumprod(dtype=np.uint64)
                for b in (np.uint64(base), np.uint64(inverse)))
        return known

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all substrings of ``width`` bytes."""
        h = (self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the hashes of ``n`` bytes from x and from y agree."""
        return (self.sums[x + n] - self.sums[x]) * self.up[y] == (self.sums[y + n] - self.sums[y]) * self.up[x]


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring values, the leftmost among equals."""
    mask = np.uint64((1 << _BITS) - 1)
    marked = grams & ~mask | np.arange(len(grams), dtype=np.uint64)
    pad = -len(marked) % width
    rows = np.concatenate([marked, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(marked) - width + 1
    return (np.minimum(after[:n], before[width - 1: width - 1 + n]) & mask).astype(np.int64)


def segments(raw: bytes) -> tuple[np.ndarray, ...]:
    """(key, digest, start, anchor, windows) of the segments of a text.

    ``anchor`` is the distance from the segment's start to its minimizer; the segment holds
    ``windows`` windows and ``windows + LENGTH - 1`` bytes.
    """
    found = []
    for at in range(0, max(0, len(raw) - LENGTH + 1), BLOCK):
        part = raw[at: at + BLOCK + LENGTH - 1]
        grams = PrefixHashes(np.frombuffer(part, dtype=np.uint8)).grams(GRAM)
        least = minimizers(grams, LENGTH - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        count = np.diff(np.append(first, len(least)))
        digest = np.fromiter((xxhash.xxh3_64_intdigest(part[s: s + n + LENGTH - 1])
                              for s, n in zip(first.tolist(), count.tolist())), dtype=np.uint64, count=len(first))
        found.append((grams[least[first]].view(np.int64), digest.view(np.int64), first + at, least[first] - first, count))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.zeros(0, dtype=np.int64) for _ in range(5))


def _segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts, n = [], []
        for text in batch["text"]:
            parts.append(segments(text.encode("utf-8", "surrogatepass")))
            n.append(len(parts[-1][0]))
        columns = [np.concatenate(c) for c in zip(*parts)]
        yield pd.DataFrame({"rid": np.repeat(batch["rid"].to_numpy(), n), "tid": np.repeat(batch["tid"].to_numpy(), n),
                            "key": columns[0], "digest": columns[1], "start": columns[2],
                            "anchor": columns[3].astype(np.int32), "windows": columns[4].astype(np.int32)})


# --- the sort -----------------------------------------------------------------------------


def common_extension(hashes: PrefixHashes, x: np.ndarray, y: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, at most ``most``, by binary search."""
    low, high = np.zeros(len(x), dtype=np.int64), np.full(len(x), most, dtype=np.int64)
    for _ in range(most.bit_length()):
        middle = (low + high + 1) >> 1
        equal = hashes.same(x, y, middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    return low


def suffix_sort(data: np.ndarray, hashes: PrefixHashes, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Merge-sort the suffixes at ``starts`` within runs of equal ``group``; returns sorted starts.

    Runs of doubling width are merged by ranking each element in the neighbouring run, with
    logarithmic comparisons of logarithmic cost.
    """
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    begin, size = np.repeat(first, size), np.repeat(size, size)
    inside = np.arange(len(group)) - begin
    starts, width = starts.copy(), 1
    while width < size.max(initial=0):
        run = inside // width
        other = (run ^ 1) * width
        n_other = np.clip(size - other, 0, width)
        active = np.flatnonzero(n_other > 0)
        low, high = np.zeros(len(active), dtype=np.int64), n_other[active].copy()
        mine, theirs, is_left = starts[active], begin[active] + other[active], run[active] % 2 == 0
        open_ = np.arange(len(active))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            x, y = mine[open_], starts[theirs[open_] + middle]
            n = common_extension(hashes, x, y)
            tied = n == LENGTH
            at = np.minimum(n, LENGTH - 1)
            # Equal suffixes of the left run come first.
            behind = np.where(tied, ~is_left[open_], data[y + at] < data[x + at])
            low[open_] = np.where(behind, middle + 1, low[open_])
            high[open_] = np.where(behind, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        place = np.arange(len(group))
        place[active] = begin[active] + np.minimum(run[active] * width, other[active]) + inside[active] % width + low
        moved = np.empty_like(starts)
        moved[place] = starts
        starts, width = moved, width * 2
    return starts


def shared_windows(groups: np.ndarray, texts: list[bytes], anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(row, distance) of the windows that another row of the same group holds too.

    Row i offers its windows at distances ``low[i]..high[i]`` before the gram, which stands at
    ``anchor[i]`` of ``texts[i]``.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    n = high - low + 1
    row = np.repeat(np.arange(len(texts)), n)
    distance = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
    code = np.unique(groups, return_inverse=True)[1][row] * np.int64(LENGTH) + distance
    order = np.argsort(code, kind="stable")
    code, starts, row, distance = code[order], (base[row] + anchor[row] - distance)[order], row[order], distance[order]
    lonely = np.concatenate([[True], code[1:] != code[:-1]]) & np.concatenate([code[1:] != code[:-1], [True]])
    code, starts, row, distance = code[~lonely], starts[~lonely], row[~lonely], distance[~lonely]
    if not len(code):
        return np.zeros((0, 2), dtype=np.int64)
    for seed in range(8):
        hashes = PrefixHashes(data, seed)
        done = suffix_sort(data, hashes, starts, code)
        pair = np.flatnonzero((code[1:] == code[:-1]))
        equal = pair[common_extension(hashes, done[pair], done[pair + 1]) == LENGTH]
        x, y, true = done[equal], done[equal + 1], True
        for k in range(0, LENGTH, 8):
            true = true and bool((_eight(data, x + k) == _eight(data, y + k)).all())
        if true:
            same = np.zeros(len(done), dtype=bool)
            same[equal] = same[equal + 1] = True
            # A start names its row and distance: texts do not overlap.
            found = np.sort(done[same])
            at = np.searchsorted(base, found, side="right") - 1
            return np.stack([at, base[at] + anchor[at] - found], 1)
    raise RuntimeError("prefix hashes collided under every base")


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def _ranges(found: np.ndarray) -> pd.DataFrame:
    """(row, distance) pairs as maximal ranges: row, low, high."""
    order = np.lexsort((found[:, 1], found[:, 0]))
    row, distance = found[order, 0], found[order, 1]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] + 1)])[: len(row)]
    last = np.concatenate([first[1:], [True]])[: len(row)]
    return pd.DataFrame({"row": row[first], "low": distance[first], "high": distance[last]})


RANGES = "key bigint, digest bigint, low int, high int"


def _sort_shard(frame: pd.DataFrame) -> pd.DataFrame:
    if not len(frame):
        return pd.DataFrame({"key": [], "digest": [], "low": [], "high": []})
    found = _ranges(shared_windows(frame["gid"].to_numpy(), frame["content"].tolist(), frame["anchor"].to_numpy(dtype=np.int64),
                                   frame["low"].to_numpy(dtype=np.int64), frame["high"].to_numpy(dtype=np.int64)))
    at = found.pop("row").to_numpy()
    return found.assign(key=frame["key"].to_numpy()[at], digest=frame["digest"].to_numpy()[at])


def _narrow(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split grams with more segments than one task may sort; returns (ranges found, rows to sort).

    Windows at distances ``lo..hi`` share a core of bytes; only rows with equal cores can share
    such a window.  A group is settled when one row is left or all rows agree on all they offer,
    and halved otherwise: at a single distance the core is the window itself.
    """
    spark = rows.sparkSession
    offered = F.expr(f"substring(content, anchor - high + 1, {LENGTH} + high - low)")
    core = F.expr(f"substring(content, anchor - lo + 1, {LENGTH} - hi + lo)")
    ranges = spark.createDataFrame([], RANGES)
    ready = spark.createDataFrame([], rows.schema)
    sizes = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > GROUP_SEGMENTS)
    if hot.isEmpty():
        return ranges, rows
    ready = rows.join(hot, "gid", "left_anti")
    state = rows.join(hot.select("gid"), "gid", "left_semi").select("*", F.lit(0).alias("lo"), F.lit(LENGTH - GRAM).alias("hi"))
    while True:
        state = materialize(
            state.withColumn("low", F.greatest("low", "lo")).withColumn("high", F.least("high", "hi")).where("low <= high")
            .withColumn("gid", F.xxhash64("gid", "lo", "hi", core))
            .withColumn("all", F.xxhash64("low", "high", offered)))
        sizes = materialize(state.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.min("all").alias("a"), F.max("all").alias("b"))
                            .where("n > 1"))
        if sizes.isEmpty():
            return ranges, ready
        known = state.join(sizes, "gid")
        ranges = ranges.unionByName(known.where("a = b").select("key", "digest", "low", "high"))
        ready = ready.unionByName(known.where((F.col("a") != F.col("b")) & (F.col("n") <= GROUP_SEGMENTS)).select(*rows.columns))
        middle = F.expr("(lo + hi) div 2").cast("int")
        split = known.where((F.col("a") != F.col("b")) & (F.col("n") > GROUP_SEGMENTS))
        halves = F.explode(F.array(F.struct(F.col("lo").alias("l"), middle.alias("h")), F.struct((middle + 1).alias("l"), F.col("hi").alias("h"))))
        state = split.select(*rows.columns, halves.alias("half")).select(*rows.columns, F.col("half.l").alias("lo"), F.col("half.h").alias("hi"))


def _content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut the wanted segments out of their texts."""
    for batch in batches:
        rows = []
        for text, wanted in zip(batch["text"], batch["wanted"]):
            raw = text.encode("utf-8", "surrogatepass")
            rows += [(w["key"], w["digest"], w["anchor"], w["windows"], raw[w["start"]: w["start"] + w["windows"] + LENGTH - 1])
                     for w in wanted]
        yield pd.DataFrame(rows, columns=["key", "digest", "anchor", "windows", "content"])


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """``rid, tid, begin, end``: stretches of bytes to remove from ``rows (rid, tid, text)``."""
    found = materialize(rows.mapInPandas(
        _segment_rows, "rid bigint, tid bigint, key bigint, digest bigint, start bigint, anchor int, windows int"))
    keys = (found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
            .where("n > 1").select("key", (F.col("a") != F.col("b")).alias("mixed")))
    met = materialize(found.join(keys, "key"))
    whole = met.where(~F.col("mixed")).select("rid", "tid", F.col("start").alias("begin"),
                                              (F.col("start") + F.col("windows") + LENGTH - 1).alias("end"))
    mixed = met.where("mixed")
    # One copy of every content; those that recur as a whole need no sorting for themselves.
    contents = materialize(mixed.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "tid", "start", "anchor", "windows")).alias("at"))
        .select("key", "digest", "n", "at.*"))
    wanted = contents.groupBy("rid", "tid").agg(
        F.collect_list(F.struct("key", "digest", "start", "anchor", "windows")).alias("wanted"))
    # A shuffle at every size: the wanted places grow with the texts.
    cut = rows.join(wanted.hint("merge"), ["rid", "tid"]).select("text", "wanted").mapInPandas(
        _content, "key bigint, digest bigint, anchor int, windows int, content binary")
    offers = materialize(cut.dropDuplicates(["key", "digest"]).select(
        F.col("key").alias("gid"), "key", "digest", "anchor", "content",
        (F.col("anchor") - F.col("windows") + 1).alias("low"), F.col("anchor").alias("high")))
    settled, to_sort = _narrow(offers)
    to_sort = materialize(to_sort)
    n_shards = max(1, -(-to_sort.count() // SHARD_SEGMENTS))
    sorted_ = (to_sort.withColumn("shard", F.pmod(F.xxhash64("gid"), F.lit(n_shards)))
               .groupBy("shard").applyInPandas(_sort_shard, RANGES))
    often = contents.where("n > 1").select("key", "digest", (F.col("anchor") - F.col("windows") + 1).alias("low"),
                                           F.col("anchor").alias("high"))
    ranges = (sorted_.unionByName(settled).unionByName(often).groupBy("key", "digest")
              .agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    partly = (mixed.join(ranges, ["key", "digest"]).select("rid", "tid", "start", "anchor", F.explode("ranges").alias("r"))
              .select("rid", "tid", (F.col("start") + F.col("anchor") - F.col("r.high")).alias("begin"),
                      (F.col("start") + F.col("anchor") - F.col("r.low") + LENGTH).alias("end")))
    return whole.unionByName(partly)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by ``spans``; spans that touch are one run."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(b, e) for b, e in out]


def _removed(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for begin, end in spans:
        kept.append(raw[at: begin])
        at = end
    return b"".join([*kept, raw[at:]])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"]):
            raw = text.encode("utf-8", "surrogatepass")
            runs = merged([(s["begin"], s["end"]) for s in spans]) if spans is not None else []
            out.append((len(raw), sum(e - b for b, e in runs), len(runs), sha256(_removed(raw, runs)).hexdigest(),
                        [{"begin": b, "end": e} for b, e in runs]))
        n, gone, k, digest, runs = zip(*out) if out else ([],) * 5
        yield pd.DataFrame({"rid": batch["rid"].to_numpy(), "n_bytes": n, "n_removed": gone, "n_spans": k, "kept_sha256": digest, "runs": runs})


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs`` for every row of ``docs``.

    A byte is removed if a 200-byte string that starts anywhere else too, in the same or another
    row, covers it; overlaps count, matches end with their text, and all strings are judged on
    the input.  ``runs`` holds the maximal removed stretches.

    Null texts are empty.  A row repeated is a copy like any other, so all of it goes if it has
    200 bytes.  Ids may be null or shared by several texts.  An empty table gives no rows; other
    columns are ignored.
    """
    rows = id_and_text(docs, id_column, text_column).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), F.xxhash64("text").alias("tid"), "text")
    # Equal texts lose equal bytes, so (id, hash of text) is key enough.
    spans = (repeated_ranges(rows.select("rid", "tid", "text")).groupBy("rid", "tid")
             .agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    schema = ("rid bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              "runs array<struct<begin: bigint, end: bigint>>")
    judged = rows.join(materialize(spans), ["rid", "tid"], "left").select("rid", "text", "spans").mapInPandas(_digests, schema)
    return judged.select(F.when(F.col("rid") != NO_ID, F.col("rid")).alias("doc_id"),
                         "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs")
