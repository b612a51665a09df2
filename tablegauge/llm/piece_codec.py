"""SentencePiece merge models: ids by a table of last tokens, and back."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import id_and_text, pieces

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words, pairs of tokens and characters kept in one Python worker.
CACHE_WORDS, CACHE_PAIRS = 300_000, 400_000


class PieceCodec:
    """Encoder and decoder of one merge-type model.

    A text is encoded through a table with one entry per prefix: its last token.  There is only
    one token that can end the encoding of a prefix: among the pieces that end there (found by an
    automaton over the vocabulary) the one that is compatible with the last token of what stands
    before it.  Two tokens are compatible if their joined text is encoded as these two; a pair is
    tried once and remembered.  The ids are read from the table backwards.

    Words are encoded apart where no piece crosses their border, and remembered.
    """

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, spec = proto.normalizer_spec, proto.trainer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge models without normalization rules are supported")
        if any(p.type in (USER, UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = bool(norm.add_dummy_prefix)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.begin = next(i for i, p in enumerate(proto.pieces) if p.piece == spec.bos_piece)
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == spec.eos_piece)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        known = {c for piece in self.ids for c in piece}
        # Lines end words if no piece holds a line feed.
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if "\n" not in known else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        # Words met lately, and those met before them.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Decoding: text of every id; bytes are joined before they are read as UTF-8.
        self.plain = [b"" if p.type == CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else
                      spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()
                      for p in proto.pieces]

    # --- encoding ---

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging, best score first, leftmost among equals.

        Used for the short texts of token pairs only.
        """
        part = list(text)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        score = self.scores
        heap = [(-score[p], i, p) for i in range(len(part) - 1) if (p := part[i] + part[i + 1]) in score]
        heapify(heap)
        while heap:
            _, i, piece = heappop(heap)
            j = after[i] if part[i] else len(part)
            if j >= len(part) or part[i] + part[j] != piece:
                continue
            part[i], part[j] = piece, ""
            after[i] = k = after[j]
            if k < len(part):
                before[k] = i
                if (p := piece + part[k]) in score:
                    heappush(heap, (-score[p], i, p))
            if (h := before[i]) >= 0 and (p := part[h] + piece) in score:
                heappush(heap, (-score[p], h, p))
        return [p for p in part if p]

    def compatible(self, one: str, two: str) -> bool:
        key = (one, two)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(one + two) == [one, two] if one else self.merge(two) == [two]
        return found

    def last_tokens(self, text: str) -> list[str]:
        """The last token of every prefix."""
        last, known, end = [""] * (len(text) + 1), self.pairs, 0
        for at, piece in self.automaton.iter(text):
            if at < end:
                continue
            if end < at:
                self._alone(text, last, end, at)
            key = (last[at + 1 - len(piece)], piece)
            fits = known.get(key)
            if fits or (fits is None and self.compatible(*key)):
                end = at + 1
                last[end] = piece
        self._alone(text, last, end, len(text))
        return last

    def _alone(self, text: str, last: list[str], start: int, stop: int) -> None:
        """Characters outside the vocabulary stand alone and merge with nothing."""
        for at in range(start, stop):
            if text[at] in self.ids:
                raise AssertionError("no piece can end a prefix")
            last[at + 1] = text[at]

    def word(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a word."""
        last, at, found = self.last_tokens(text), len(text), []
        while at:
            piece = last[at]
            if piece in self.ids:
                found.append(self.ids[piece])
            elif self.bytes:
                found += [self.bytes[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            else:
                found.append(self.unknown)
            at -= len(piece)
        return np.array(found[::-1], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text with begin and end ids, as bytes; an empty text has only these two."""
        head, tail = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        if not text:
            return head + tail
        words = self.cut.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))
        memory = self.words
        try:
            return b"".join([head, *[memory[w] for w in words], tail])
        except KeyError:
            pass
        if len(memory) >= CACHE_WORDS:
            self.older, self.words = memory, {}
            memory = self.words
        for w in words:
            if w not in memory:
                memory[w] = self.older.get(w) or self.word(w)
        return b"".join([head, *[memory[w] for w in words], tail])

    # --- decoding ---

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text behind ``ids``; bytes that are no UTF-8 become U+FFFD each."""
        plain = self.plain
        raw = b"".join([plain[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_CODECS: dict[int, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per worker and model; its memory outlives the task."""
    key = zlib.crc32(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def shared_model(docs: DataFrame, model_file: str) -> Broadcast:
    with open(model_file, "rb") as source:
        return docs.sparkSession.sparkContext.broadcast(source.read())


def encode(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every text as little-endian unsigned 32-bit numbers in bytes."""
    shared = shared_model(docs, model_file)

    @F.pandas_udf(T.BinaryType())
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(shared.value)
        return pd.Series([own.encode(t) for t in texts], dtype=object)

    return id_and_text(docs, id_column, text_column).select("doc_id", ids(F.col("text")).alias("ids"))


def decode(coded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    shared = shared_model(coded, model_file)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        own = codec(shared.value)
        return pd.Series([own.decode(i or b"").decode() for i in ids], dtype=object)

    return coded.select("doc_id", text(F.col("ids")).alias("text"))


def round_trip(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, digest, decode, digest, in one pass.

    A null text is empty: begin and end ids only, decoded to an empty text.  Rows are coded one
    by one, repeated rows alike; an empty table gives no rows; other columns are ignored.
    """
    from hashlib import sha256

    shared = shared_model(docs, model_file)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(shared.value)
        for batch in batches:
            for part in pieces(batch, ["text"]):
                rows = []
                for t in part["text"]:
                    ids = own.encode(t)
                    rows.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(own.decode(ids)).hexdigest()))
                n, one, two = zip(*rows)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": n, "ids_sha256": one, "decoded_sha256": two})

    # Ids travel as text: pandas would turn a column with nulls into floats.
    out = id_and_text(docs, id_column, text_column).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        coded, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
