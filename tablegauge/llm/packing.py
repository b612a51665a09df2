"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import id_and_text, pieces
from tablegauge.session import materialize

LENGTH, END_ID = 2048, 0
#: Pieces that one shard packs, islands per shard, and the work of an island.
SHARD_PIECES, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 20_000, 3, 2, 4, 4
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# --- tokens ------------------------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others, in order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Letters and spaces on whose classes all regular-expression engines agree.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e]")


class Tokenizer:
    """Ids of a byte-level BPE definition.

    The vocabulary is used as ranks, which is much faster; texts with characters outside
    ``PLAIN`` go through the definition's own library.
    """

    def __init__(self, definition: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(definition)
        self.library.encode_special_tokens = True
        letters = _byte_letters()
        parts = json.loads(definition)
        special = {t["content"] for t in parts["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in parts["model"]["vocab"].items() if token not in special}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if PLAIN.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, dtype="<u4").tobytes()


_TOKENIZERS: dict[int, Tokenizer] = {}


def _tokenizer(shared: Broadcast) -> Tokenizer:
    """One tokenizer per worker and definition."""
    definition = shared.value
    key = zlib.crc32(definition.encode())
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer(definition)
    return _TOKENIZERS[key]


def cut(n_ids: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but the first."""
    first = n_ids % length or length
    return [(0, first), *((s, length) for s in range(first, n_ids, length))]


def token_pieces(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, end id included."""
    with open(tokenizer_file, encoding="utf-8") as source:
        shared = docs.sparkSession.sparkContext.broadcast(source.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(shared)
        for batch in batches:
            for part in pieces(batch, ["text"]):
                rows = []
                for i, text in enumerate(part["text"]):
                    ids = encode(text) + end
                    rows += [(i, k, s, n, zlib.crc32(ids[4 * s: 4 * (s + n)]))
                             for k, (s, n) in enumerate(cut(len(ids) // 4, length))]
                of, piece, start, size, crc = zip(*rows)
                yield pd.DataFrame({"doc_id": part["doc_id"].iloc[list(of)].to_numpy(), "piece": piece, "start": start,
                                    "length": size, "ids_crc32": crc})

    # Null ids would turn the column into floats on the way through pandas: ids travel as text.
    rows = id_and_text(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(tokenize, PIECES.replace("doc_id bigint", "doc_id string"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


# --- the grouping genetic algorithm ----------------------------------------------------------


def best_fit(sizes: np.ndarray, items: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put ``items`` one by one where the least room is left; ``bins`` and ``room`` grow in place."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i in items:
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(0)
        room[b] = r - size
        if room[b] > 0:
            by_room.setdefault(room[b], []).append(b)
            mask |= 1 << room[b]


def fitness(bins: list[list[int]], room: list[int], capacity: int) -> float:
    """Mean squared fill: fewer and fuller bins are better."""
    fill = 1 - np.array(room) / capacity
    return float((fill * fill).mean()) if len(bins) else 1.0


def cross(sizes: np.ndarray, one: tuple, two: tuple, capacity: int, random: np.random.Generator) -> tuple:
    """Inject well-filled bins of ``two`` into ``one``.

    Bins of ``one`` that share a piece with an injected bin are removed; their other pieces are
    put back by best fit, largest first.
    """
    full = [b for b, r in enumerate(two[1]) if r == 0] or [int(np.argmin(two[1]))]
    chosen = random.choice(full, size=max(1, len(full) // 2), replace=False)
    taken = {i for b in chosen for i in two[0][b]}
    bins, room, displaced = [list(two[0][b]) for b in chosen], [two[1][b] for b in chosen], []
    for b, members in enumerate(one[0]):
        if taken.isdisjoint(members):
            bins.append(list(members))
            room.append(one[1][b])
        else:
            displaced += [i for i in members if i not in taken]
    # The emptiest bin is given up too: its pieces may close gaps elsewhere.
    if bins:
        worst = int(np.argmax(room))
        if not any(i in taken for i in bins[worst]):
            displaced += bins.pop(worst)
            room.pop(worst)
    displaced.sort(key=lambda i: (-sizes[i], i))
    best_fit(sizes, displaced, bins, room, capacity)
    return bins, room


def evolve(sizes: np.ndarray, immigrants: list[list[list[int]]], seed: int, capacity: int,
           population: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[list[int]], list[int]]:
    """The best packing an island finds; it stops at the lower bound on the number of bins."""
    random = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    people: list[tuple[list[list[int]], list[int]]] = [
        (bins, [capacity - int(sizes[b].sum()) for b in bins]) for bins in immigrants]
    while len(people) < population:
        # Best fit, largest first; all but the first are shaken a little.
        shaken = sizes + (random.random(len(sizes)) * 0.1 * capacity if people else 0)
        bins: list[list[int]] = []
        room: list[int] = []
        best_fit(sizes, np.lexsort((np.arange(len(sizes)), -shaken)).tolist(), bins, room, capacity)
        people.append((bins, room))
        if len(bins) <= least:
            return bins, room
    value = lambda p: (len(p[0]), -fitness(*p, capacity))
    for _ in range(generations):
        people.sort(key=value)
        if len(people[0][0]) <= least:
            break
        children = [cross(sizes, people[0], people[k], capacity, random) for k in range(1, len(people))]
        people = sorted([*people, *children], key=value)[:population]
    return min(people, key=value)


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a shard in an order that only their values decide."""
    return frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True],
                             kind="stable", ignore_index=True)


def _pack_shards(items: DataFrame, length: int, seed: int) -> DataFrame:
    """Pack every shard of ``items`` (PIECES + shard); adds ``bin`` and ``room``."""
    elite_schema = "shard bigint, island int, n_bins bigint, fit double, bins array<array<int>>"
    islands = items.select("shard", "length", "doc_id", "piece", "ids_crc32",
                           F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))

    def live(key: tuple, mine: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        sizes = _ordered(mine)["length"].to_numpy(dtype=np.int64)
        best = evolve(sizes, [[np.asarray(b, dtype=int).tolist() for b in g] for g in guests["bins"]],
                      hash((seed, int(key[0]), int(key[1]))) & 0x7FFFFFFF, length)
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "n_bins": [len(best[0])],
                             "fit": [fitness(*best, length)], "bins": [best[0]]})

    elite = items.sparkSession.createDataFrame([], elite_schema)
    for _ in range(EPOCHS):
        # Elites move one island on.
        guests = elite.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        grown = islands.groupBy("shard", "island").cogroup(guests.groupBy("shard", "island"))
        elite = materialize(grown.applyInPandas(lambda k, a, b: live(k, a, b) if len(a) else pd.DataFrame(
            {"shard": [], "island": [], "n_bins": [], "fit": [], "bins": []}), elite_schema))
    best = elite.groupBy("shard").agg(F.max(F.struct(-F.col("n_bins"), "fit", -F.col("island"), "bins")).alias("b"))

    def place(key: tuple, mine: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows, bins = _ordered(mine), chosen["bins"].iloc[0] if len(chosen) else []
        where = np.zeros(len(rows), dtype=np.int64)
        offset = np.zeros(len(rows), dtype=np.int64)
        room = np.zeros(len(rows), dtype=np.int64)
        sizes = rows["length"].to_numpy(dtype=np.int64)
        for b, members in enumerate(bins):
            m = np.asarray(members, dtype=np.int64)
            where[m], offset[m], room[m] = b, np.cumsum(sizes[m]) - sizes[m], length - sizes[m].sum()
        return rows.assign(bin=where, offset=offset, room=room)

    schema = f"{PIECES.replace('doc_id bigint', 'doc_id string')}, shard bigint, bin bigint, offset bigint, room bigint"
    return items.groupBy("shard").cogroup(best.select("shard", "b.bins").groupBy("shard")).applyInPandas(place, schema)


def pack(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = END_ID, seed: int = 1,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every piece in its place.

    Pieces are dealt by hash into shards of about ``shard_pieces``; the islands of a shard evolve
    apart and send their best packing to the next island after each epoch.  The emptiest bin of
    every shard is opened again and packed with those of the other shards.

    A null or empty text is one piece with the end id alone.  Ids may be null or repeated; each
    row has its own pieces.  An empty table gives no rows; other columns are ignored.
    """
    cut_up = materialize(token_pieces(docs, tokenizer_file, length, end_id)
                         .withColumn("doc_id", F.col("doc_id").cast("string")))
    def shards(n: int) -> int:
        return max(1, -(-n // shard_pieces))

    def dealt(frame: DataFrame, n: int) -> DataFrame:
        return frame.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(n)))

    n_shards = shards(cut_up.count())
    packed = materialize(_pack_shards(dealt(cut_up, n_shards), length, seed))
    if n_shards > 1:
        emptiest = packed.groupBy("shard").agg(F.max(F.struct("room", "bin")).alias("e")).select("shard", "e.bin")
        marked = packed.join(emptiest.withColumn("open", F.lit(True)), ["shard", "bin"], "left")
        again = materialize(marked.where("open").select(*cut_up.columns))
        closed = marked.where(F.col("open").isNull()).select(*packed.columns)
        more = _pack_shards(dealt(again, shards(again.count())), length, seed + 1)
        packed = closed.unionByName(more.withColumn("shard", F.col("shard") + n_shards))
    return packed.select(F.col("doc_id").cast("bigint").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                         (F.shiftleft("shard", 32) + F.col("bin")).alias("sequence_id"), "offset")
