"""Near duplicates: MinHash tables tensored from two smaller collections of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import fresh, id_and_text, pieces
from tablegauge.session import broadcast_if_small, materialize

WIDTH, PERCENT = 4, 80
#: Each side has SIDE keys of HASHES minima; SIDE * SIDE tables come from 2 * SIDE * HASHES minima.
#: A pair of similarity 0.8 meets in no table with chance 2 * (1 - 0.8 ** 3) ** 16 = 2e-5, one of
#: 0.85 with 5e-7; a pair of 0.8 meets in 67 tables on average.
SIDE, HASHES = 16, 3
#: Equal minima, of all 2 * SIDE * HASHES, from which on a pair of a mixed bucket is compared on its
#: full sets: a pair of similarity 0.8 has 77 +- 4 and falls below with chance 2e-6.
LEAST_EQUAL = 58
#: Members of a key that meet in one piece, and rows of a task.
CELL_ROWS, SHARD_ROWS = 2_000, 10_000
#: Bytes of shortened sets of a task, and values compared at once.
SHARD_BYTES, COMPARED = 24_000_000, 2_000_000
CACHE_WORDS = 150_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A full 64-bit mixing step."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; shorter texts are one shingle.

    Only A-Z are lower-cased and only ``[\x20\x09-\x0D]`` separates words: exactly what bytes do.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    width, count = min(width, len(h)), max(1, len(h) - width + 1)
    total = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total + h[k: k + count])
    return np.unique(total)


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_A = _multipliers(2 * SIDE * HASHES, 11)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """``2 * SIDE`` keys of a set, left ones, then right ones, and 16 bits of each minimum.

    The low 6 bits of a key hold its place, so keys of different places never agree.
    """
    least = np.array([(hashes * m).min() for m in _A])
    keys = np.zeros(2 * SIDE, dtype=np.uint64)
    for k in range(HASHES):
        keys = mix(keys + least[k::HASHES] + np.uint64(k + 1))
    return keys & ~np.uint64(63) | np.arange(2 * SIDE, dtype=np.uint64), mix(least).astype(np.uint16).tobytes()


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in pieces(batch, ["text"]):
            n, digest, keys, minima = [], [], [], []
            for text in part["text"]:
                s = shingles(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                own = sketch(s) if len(s) else None
                keys.append(own[0].view(np.int64) if own else None)
                minima.append(own[1] if own else None)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": n, "digest": digest, "keys": keys, "minima": minima})
    _WORDS.clear()


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in pieces(batch, ["text"]):
            yield part[["a", "b"]].assign(hashes=[shingles(t).view(np.int64) for t in part["text"]])
    _WORDS.clear()


def _short_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets with 16 bits of each hash: they never show fewer common values than the full sets."""
    for batch in batches:
        for part in pieces(batch, ["text"]):
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "short": [shingles(t).astype(np.uint16).tobytes() for t in part["text"]]})
    _WORDS.clear()


def _alike(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs of different components in the cells of a shard that may be similar.

    A pair is taken under its first common left key only, if it has a common right key, enough
    equal minima and, by the short sets, enough common shingles.
    """
    found = []
    frame = frame.sort_values(["cell", "doc_id"], ignore_index=True)
    ends = np.flatnonzero(np.append(frame["cell"].to_numpy()[1:] != frame["cell"].to_numpy()[:-1], True)) + 1
    minima = np.frombuffer(b"".join(frame["minima"]), dtype=np.uint16).reshape(len(frame), -1)
    short = [np.frombuffer(x, dtype=np.uint16) for x in frame["short"]]
    size = np.array([len(x) for x in short])
    ids, parts, block, key = (frame[c].to_numpy() for c in ("doc_id", "component", "block", "key"))
    diagonal, start, present = frame["diagonal"].to_numpy(), 0, np.zeros(1 << 16, dtype=bool)
    for end in ends.tolist():
        place = int(key[start]) & 63
        for x in range(start, end):
            y = np.arange(x + 1, end)
            y = y[(parts[y] != parts[x]) & (100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x]))]
            if not diagonal[start]:
                y = y[block[y] != block[x]]
            if len(y):
                equal = minima[y] == minima[x]
                keys = equal.reshape(len(y), 2 * SIDE, HASHES).all(2)
                y = y[(equal.sum(1) >= LEAST_EQUAL) & ~keys[:, :place].any(1) & keys[:, SIDE:].any(1)]
            if len(y):
                present[short[x]] = True
                # Long sets are met a few at a time.
                at = np.cumsum(size[y]) // COMPARED
                common = np.minimum(np.concatenate([
                    np.add.reduceat(present[np.concatenate([short[k] for k in some])], np.append(0, np.cumsum(size[some])[:-1]), dtype=np.int32)
                    for some in np.split(y, np.flatnonzero(np.diff(at)) + 1)]), size[x])
                present[short[x]] = False
                y = y[100 * common >= PERCENT * (size[x] + size[y] - common)]
                found.append(np.stack([np.full(len(y), ids[x]), ids[y]], 1))
        start = end
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})


def _cells(members: DataFrame) -> DataFrame:
    """Members of left keys, dealt into cells of bounded size in which every pair meets once.

    A key of more than CELL_ROWS members is dealt into blocks; each two blocks make a cell.
    """
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = members.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / CELL_ROWS).cast("int"))
    dealt = (sized.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return (dealt.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
            .withColumn("diagonal", F.col("block") == F.col("other")).drop("n", "blocks", "other"))


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs with 100 * common >= PERCENT * union, on full sets."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"]):
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.loc[keep, ["a", "b"]]


def _verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``(a, b)`` among ``pairs`` that are similar: the set of b travels once, to that of a."""
    pairs = materialize(pairs)
    leaders = materialize(pairs.select("a").distinct())
    schema = "a bigint, b bigint, hashes array<bigint>"
    followers = rows.join(broadcast_if_small(pairs, 2), rows["doc_id"] == pairs["b"]).select("a", "b", "text")
    first = rows.join(broadcast_if_small(leaders), rows["doc_id"] == leaders["a"]).select("a", F.col("a").alias("b"), "text")
    y = followers.mapInPandas(_sets, schema).select("a", "b", F.col("hashes").alias("y"))
    x = first.mapInPandas(_sets, schema).select("a", F.col("hashes").alias("x"))
    return materialize(y.join(x, "a").mapInPandas(_similar, "a bigint, b bigint").distinct())


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the least node reachable over ``edges (a, b)``.

    Every round each node points all its larger neighbours to its smallest one, then its smaller
    ones; long chains shrink by a constant factor a round.  Hot nodes are combined before they
    are shuffled.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours move to the smallest of the neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        following = materialize(small)
        # Done when every node has one edge, and none leads on.
        again = following.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        leads = following.join(following.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        edges = following
        if again and leads:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _tables(half: DataFrame) -> DataFrame:
    """``(bucket, doc_id)`` of all tables in which a set meets another: left key with right key.

    Half keys that only one set has are dropped first, as no table with them can hold two.
    """
    met = half.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    kept = materialize(half.join(met, "key", "left_semi"))
    is_left = F.col("key").bitwiseAND(F.lit(63)) < SIDE
    sides = kept.groupBy("doc_id").agg(F.collect_set(F.when(is_left, F.col("key"))).alias("left"),
                                       F.collect_set(F.when(~is_left, F.col("key"))).alias("right"))
    all_ = (sides.select("doc_id", F.explode("left").alias("l"), "right")
            .select("doc_id", "l", F.explode("right").alias("r"))
            .select(F.xxhash64("l", "r").alias("bucket"), "doc_id"))
    shared = all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return all_.join(shared, "bucket", "left_semi")


def _place(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """``cells`` with the component of every document."""
    return (cells.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")))


def _mixed(placed: DataFrame) -> DataFrame:
    """``(doc_id, component)`` of the members of buckets that hold several components."""
    ends = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return placed.join(ends.select("bucket"), "bucket", "left_semi").select("doc_id", "component").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Sets are distinct 4-word shingles; sets with ``100 * common >= 80 * union`` are linked, and a
    component is named by its smallest id.

    1. Sets are sketched; rows of equal sets are one from here on.
    2. Left and right keys are combined to tables.  Every set is compared with that first member
       of its buckets which it meets most often; confirmed links make components.
    3. First members and others of a bucket in different components are compared.
    4. The members of buckets that still hold several components meet under their left keys;
       those of different components that share a right key too are compared inside the tasks, by
       minima and by shortened sets.  Neither drops a similar pair; what is left is confirmed on
       the full sets.

    So a large group of near copies costs a comparison per member, not per pair.

    Texts without words have empty sets and are linked with nothing, not even each other.  A null
    id never links, has a null component and is kept.  Rows repeated with one id and
    set share a verdict; an id with two sets links both.  Empty tables give no rows; other
    columns are ignored.
    """
    rows = id_and_text(docs, id_column, text_column)
    # Null ids cannot be reached by a link.
    sketches = materialize(rows.where("doc_id IS NOT NULL").mapInPandas(
        _sketch, "doc_id bigint, n_shingles bigint, digest string, keys array<bigint>, minima binary"))
    full = sketches.where("n_shingles > 0")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    one = full.join(classes, (full["digest"] == classes["digest"]) & (full["doc_id"] == classes["rep"]), "left_semi") \
        .dropDuplicates(["doc_id", "digest"])
    half = one.select("doc_id", F.explode("keys").alias("key"))
    buckets = materialize(_tables(half))
    copies = full.join(classes, "digest").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    # 2: one comparison per set.
    first = buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"))
    stars = materialize(buckets.join(first, "bucket").where("a <> doc_id")
                        .groupBy("a", F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    nearest = stars.groupBy("b").agg(F.max(F.struct("n", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")
    links = _verified(nearest, rows)
    parts = materialize(connected(links))
    # 3: the other first members.
    named = parts.withColumnRenamed("node", "doc_id")
    side = lambda c: named.select(F.col("doc_id").alias(c), F.col("component").alias(f"c{c}"))
    apart = (stars.join(side("a"), "a", "left").join(side("b"), "b", "left")
             .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(apart, rows))
    parts = materialize(connected(links))
    # 4: what still lies in mixed buckets.
    mixed = materialize(_mixed(_place(buckets, parts)))
    short = rows.join(broadcast_if_small(mixed.select("doc_id")), "doc_id", "left_semi").mapInPandas(
        _short_sets, "doc_id bigint, short binary")
    detailed = one.select("doc_id", "minima", F.filter("keys", lambda k: k.bitwiseAND(F.lit(63)) < SIDE).alias("keys"))
    members = (mixed.join(detailed, "doc_id").join(short, "doc_id")
               .select("doc_id", "component", "minima", "short", F.explode("keys").alias("key")))
    # A member is in SIDE cells, with its shortened set in each.
    load = mixed.join(one.select("doc_id", "n_shingles"), "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("values")).first()
    n_shards = max(1, -(-SIDE * load["rows"] // SHARD_ROWS), -(-SIDE * 2 * (load["values"] or 0) // SHARD_BYTES))
    pairs = (_cells(members).withColumn("shard", F.pmod(F.col("cell"), F.lit(n_shards)))
             .groupBy("shard").applyInPandas(_alike, "a bigint, b bigint").distinct())
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(_verified(pairs.join(seen, ["a", "b"], "left_anti"), rows))
    parts = connected(links.unionByName(copies))
    parts = parts.withColumnRenamed("node", "doc_id")
    found = sketches.select("doc_id", "n_shingles").join(parts, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nulls = rows.where("doc_id IS NULL").mapInPandas(
        lambda batches: (pd.DataFrame({"n_shingles": [len(shingles(t)) for t in b["text"]]}) for b in batches), "n_shingles bigint")
    nulls = nulls.select(F.lit(None).cast("bigint").alias("doc_id"), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return found.unionByName(nulls).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component of ``docs``, with all its columns."""
    (gone,) = fresh(docs, "gone")
    dropped = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    dropped = broadcast_if_small(materialize(dropped))
    return docs.join(dropped, docs["doc_id"] == dropped[gone], "left_anti")
