"""Byte-level BPE: ids by a table of each prefix's last token, and back."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import id_and_text, pieces

#: Words and pairs of tokens that one Python worker remembers, and the longest word it does.
CACHE_WORDS, CACHE_PAIRS, LONGEST_KEPT = 300_000, 400_000, 64
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabularies: printable ones for themselves, the
    others, in order, for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Ranges of characters on whose classes all engines agree; texts with others are split by the library.
KNOWN = "".join(chr(c) for r in ((9, 11), (13, 14), (0x20, 0x7F), (0xA1, 0x250), (0x391, 0x3A2), (0x3A3, 0x482), (0x48A, 0x530),
                                 (0x2010, 0x2028), (0x2030, 0x205F)) for c in range(*r))


def _class(test) -> str:
    return "".join(re.escape(c) for c in KNOWN if test(c))


STRANGE = re.compile(f"[^{_class(lambda c: True)}]")
_LETTER, _NUMBER = _class(str.isalpha), _class(lambda c: c.isnumeric() and not c.isalpha())
_SIGN = _class(lambda c: not c.isalnum() and not c.isspace())
#: The words of a text without strange characters: contractions, letters, numbers, signs, white space.
WORDS = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]+| ?[{_SIGN}]+|\s+(?!\S)|\s+")


class ByteCodec:
    """Encoder and decoder of one byte-level BPE definition.

    A word is encoded through a table with one entry per prefix: its last token.  Only one token
    can end the encoding of a prefix: among the tokens that end there (found by the suffix links of
    an automaton over the vocabulary) the one that is compatible with the last token of what
    stands before it.  The ids are read from the table backwards.

    Two tokens are compatible if no merge joins them across their border.  The parts that lie at
    the border while merges go on are the right spine of the left token and the left spine of the
    right one; each lives from the merge that makes it to the one that takes it up.  A merge of
    two parts that live at its turn would come first, so then the pair is not stable.
    """

    def __init__(self, definition: str) -> None:
        import ahocorasick
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        model, pre = parts["model"], parts["pre_tokenizer"] or {}
        if (model["type"] != "BPE" or parts["normalizer"] or model["dropout"] or model["byte_fallback"] or model["ignore_merges"]
                or model["continuing_subword_prefix"] or model["end_of_word_suffix"]):
            raise ValueError("only plain merge models without normalization are supported")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only the byte-level split into words is supported")
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in parts["added_tokens"]):
            raise ValueError("added tokens with conditions are not supported")
        self.split = Tokenizer.from_str(definition).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.added = {content: np.array([i], dtype="<u4").tobytes() for content, i in added.items()}
        self.special = re.compile("|".join(re.escape(c) for c in sorted(added, key=len, reverse=True))) if added else None
        tokens = {t: i for t, i in model["vocab"].items() if t not in added}
        # Tokens as strings with one character per byte.
        text = {i: "".join(chr(letters[c]) for c in t) for t, i in tokens.items()}
        self.size = {i: len(t) for i, t in text.items()}
        self.plain = [b""] * (1 + max([*text, *added.values()]))
        for i, t in text.items():
            self.plain[i] = t.encode("latin-1")
        for content, i in added.items():
            self.plain[i] = content.encode()
        self._read_merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], tokens)
        self.automaton = ahocorasick.Automaton()
        for i, t in text.items():
            if self.made[i] == -1 or self._stands(i):
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        # Words met lately, and those met before them.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _read_merges(self, merges: list, tokens: dict[str, int]) -> None:
        """``turn`` of each pair of tokens; what each token is made of, and when."""
        self.turn: dict[tuple[int, int], int] = {}
        self.made = dict.fromkeys(tokens.values(), -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for turn, (a, b) in enumerate(merges):
            pair, whole = (tokens[a], tokens[b]), tokens[a + b]
            if whole in self.halves or max(self.made[pair[0]], self.made[pair[1]]) >= turn:
                raise ValueError("a token has two makings, or is used before it is made")
            self.turn[pair], self.made[whole], self.halves[whole] = turn, turn, pair
        if any(made == -1 and self.size[i] > 1 for i, made in self.made.items()):
            raise ValueError("a token of several bytes is never made")

    # --- encoding ---

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """``(part, turn at which it is taken up)`` at the left (0) or right (1) end of a token."""
        out = [(token, NEVER)]
        while token in self.halves:
            out.append((self.halves[token][side], self.made[token]))
            token = self.halves[token][side]
        return out

    def crossing(self, one: int, two: int) -> int:
        """The turn of the first merge across the border of two tokens; NEVER if there is none.

        Of equal pairs the left one is merged first: a part is not free at the very turn at
        which its left neighbour takes it up, but is when its right neighbour would.
        """
        right, turn, first = self._spine(two, 0), self.turn, NEVER
        for a, a_ends in self._spine(one, 1):
            for b, b_ends in right:
                t = turn.get((a, b), NEVER)
                if t < a_ends and t <= b_ends and t < first:
                    first = t
        return first

    def _stands(self, token: int) -> bool:
        """Is the text of a token encoded as this token?  So it is if its last merge comes first at
        the border of its halves, and the halves stand."""
        one, two = self.halves[token]
        return self.crossing(one, two) == self.made[token] and all(self.made[h] == -1 or self._stands(h) for h in (one, two))

    def compatible(self, one: int, two: int) -> bool:
        found = self.pairs.get((one, two))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[one, two] = self.crossing(one, two) == NEVER
        return found

    def last_tokens(self, word: str) -> list[int]:
        """The last token of every prefix of a word that has one character per byte."""
        last, size, known, end = [-1] * (len(word) + 1), self.size, self.pairs, 0
        for at, token in self.automaton.iter(word):
            if at < end:
                continue
            start = at + 1 - size[token]
            if start:
                fits = known.get((last[start], token))
                if fits is None:
                    fits = self.compatible(last[start], token)
                if not fits:
                    continue
            end = at + 1
            last[end] = token
        return last

    def word(self, word: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a word."""
        raw = word.encode("utf-8", "surrogatepass")
        last, at, found = self.last_tokens(raw.decode("latin-1")), len(raw), []
        while at:
            found.append(last[at])
            at -= self.size[last[at]]
        return np.array(found[::-1], dtype="<u4").tobytes()

    def _plain_text(self, text: str) -> list[bytes]:
        words = [text[a:b] for _, (a, b) in self.split(text)] if STRANGE.search(text) else WORDS.findall(text)
        memory = self.words
        try:
            return [memory[w] for w in words]
        except KeyError:
            pass
        out = []
        for w in words:
            ids = memory.get(w)
            if ids is None:
                ids = self.older.get(w) or self.word(w)
                if len(w) <= LONGEST_KEPT:
                    if len(memory) >= CACHE_WORDS:
                        self.older, self.words = memory, {}
                        memory = self.words
                    memory[w] = ids
            out.append(ids)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes; the strings of added tokens stand for these."""
        if not self.special or not (marks := list(self.special.finditer(text))):
            return b"".join(self._plain_text(text))
        out, at = [], 0
        for m in marks:
            out += [*self._plain_text(text[at: m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, *self._plain_text(text[at:])])

    # --- decoding ---

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text behind ``ids``, added tokens included; what is no UTF-8 becomes U+FFFD."""
        plain = self.plain
        raw = b"".join([plain[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_CODECS: dict[int, ByteCodec] = {}


def codec(definition: str) -> ByteCodec:
    """One codec per worker and definition; its memory outlives the task."""
    key = zlib.crc32(definition.encode())
    if key not in _CODECS:
        _CODECS[key] = ByteCodec(definition)
    return _CODECS[key]


def shared_definition(frame: DataFrame, definition_file: str) -> Broadcast:
    """The definition's text for all tasks: its size is that of a vocabulary."""
    with open(definition_file, encoding="utf-8") as source:
        return frame.sparkSession.sparkContext.broadcast(source.read())


def encode(docs: DataFrame, definition_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every text as little-endian unsigned 32-bit numbers in bytes.

    Null texts are empty and have no ids.
    """
    shared = shared_definition(docs, definition_file)

    @F.pandas_udf(T.BinaryType())
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(shared.value)
        return pd.Series([own.encode(t) for t in texts], dtype=object)

    return id_and_text(docs, id_column, text_column).select("doc_id", ids(F.col("text")).alias("ids"))


def decode(coded: DataFrame, definition_file: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    shared = shared_definition(coded, definition_file)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        own = codec(shared.value)
        return pd.Series([own.decode(i or b"").decode() for i in ids], dtype=object)

    return coded.select("doc_id", text(F.col("ids")).alias("text"))


def round_trip(docs: DataFrame, definition_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode, digest, decode, digest, in one pass.

    A null or empty text has no tokens and decodes to an empty text.  Rows are coded one by one,
    repeated rows alike; ids may be null or repeated; an empty table gives no rows; other columns
    are ignored.  Long texts are coded word by word, a word of any length in memory in proportion.
    """
    shared = shared_definition(docs, definition_file)

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

    # Document ids travel as text: pandas would turn a column with nulls into floats.
    out = id_and_text(docs, id_column, text_column).select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        coded, "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))
