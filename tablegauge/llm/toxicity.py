"""Toxicity of texts that may be disguised: a noisy channel, then learned word stems.

1. Character 4-gram counts over all documents give a language model.
2. A token that is not plain letters (digits and signs for letters, letters drawn out, letters
   spaced apart) is a lattice of readings; the cheapest path under model and channel is what it
   was meant to be.  Letters with a doubled one may be meant so or not: they are read both ways.
3. A sequential covering of labelled rows picks the word stems and words that tell toxic texts.
   A document's score is the noisy-or of the distinct ones among its restored words.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm.common import held_out, id_and_text
from tablegauge.session import materialize

#: Symbols of the language model: 0 ends a word, 1-26 a-z, 27-31 other letters by code point.
ALPHABET = 32
ORDER = 4
#: What a sign may stand for.  Fixed values of the channel.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
            "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "¡": "i"}
#: Channel costs in nats.
READ_COST, DROP_SIGN_COST, DROP_REPEAT_COST = 1.0, 1.0, 0.5
#: Rows used to learn, and the least evidence a feature needs.
SAMPLE_ROWS, ACCEPT, SURE, STEMS = 20_000, 0.7, 0.9, (4, 5, 6, 7)
#: Features a task counts before it sends them on.
COUNTED_FEATURES = 300_000
#: Scores kept per Python worker before the memory is emptied.
CACHE_WORDS = 200_000
THRESHOLD = 0.7

_SYMBOLS = np.zeros(0x250, dtype=np.uint32)
for _c in range(0x250):
    if chr(_c).isalpha():
        _SYMBOLS[_c] = _c - 96 if 97 <= _c <= 122 else 27 + _c % 5
#: Three or more one-character tokens in a row.
SPACED = re.compile(r"(?<!\S)(?:\S\s++){2,}\S(?!\S)")
RUN = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1")
#: Ends a word of which only the beginning is known.
OPEN = "\t"
#: Longer strings of letters are no words: spaced runs end in closed words of up to so many letters.
LONGEST_WORD = 256
TAIL = ".,;:!?\"')]}…»”"
RULED_TAIL = re.compile(r"[#*%&$!~=_|-]{3,}$")


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _SYMBOLS[np.minimum(code, 0x24F)]
    high = code >= 0x250
    if high.any():
        out = out.copy()
        out[high] = 27 + code[high] % 5
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(ALPHABET**ORDER, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            s = symbols(f"   {text.lower()} ")
            grams = s[:-3] << 15 | s[1:-2] << 10 | s[2:-1] << 5 | s[3:]
            if len(grams) > 50_000:
                total += np.bincount(grams, minlength=len(total))
            else:
                which, n = np.unique(grams, return_counts=True)
                total[which] += n
    at = np.nonzero(total)[0]
    yield pd.DataFrame({"gram": at.astype(np.int32), "n": total[at]})


def language_model(docs: DataFrame) -> np.ndarray:
    """-log p(symbol | three before), as a flat array, from all texts.

    At most 32^4 counts reach the driver, whatever the number of documents.
    """
    counts = (id_and_text(docs).select("text").mapInPandas(_count, "gram int, n bigint")
              .groupBy("gram").agg(F.sum("n").alias("n")).toPandas())
    n = np.zeros(ALPHABET**ORDER)
    n[counts["gram"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    n = n.reshape([ALPHABET] * ORDER)
    lower = n.sum((0, 1)) + 0.5                       # symbol after one
    low = lower / lower.sum(-1, keepdims=True)
    mid = n.sum(0) + 5 * low[None]                    # symbol after two
    mid = mid / mid.sum(-1, keepdims=True)
    full = n + 5 * mid[None]
    return (-np.log(full / full.sum(-1, keepdims=True))).astype(np.float32).ravel()


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest plain word behind ``token`` (lower case), by Viterbi decoding of its lattice.

    A state is the last three symbols; every character may be read as itself, as the letters it
    can stand for, dropped as a separator, or dropped as a repetition of the one before it.
    Paths are chains of letters that share their beginnings, so a token of any length fits.
    """
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    before, done, at = "", [], 0
    for i, ch in enumerate(token):
        if len(states) == 1 and i - at >= LONGEST_WORD:
            (state, (cost, path)), at = *states.items(), i
            done.append(_spelled(path))
            states = {state: (cost, None)}
        if ch.isalpha():
            options = [(ch, _symbol(ch), 0.0)]
            if ch == before:
                options.append(("", 0, DROP_REPEAT_COST))
        else:
            options = [(c, ord(c) - 96, READ_COST) for c in READINGS.get(ch, "")] + [("", 0, DROP_SIGN_COST)]
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for out, s, extra in options:
                if out:
                    step = state << 5 | s
                    to, total = step & 0x7FFF, cost + extra + float(model[step])
                else:
                    to, total = state, cost + extra
                if to not in reached or total < reached[to][0]:
                    reached[to] = (total, (path, out) if out else path)
        states, before = reached, ch
    ends = [(cost + float(model[state << 5]), path) for state, (cost, path) in states.items()]
    least = min(cost for cost, _ in ends)
    return "".join(done) + min(_spelled(path) for cost, path in ends if cost == least)


def _symbol(ch: str) -> int:
    code = ord(ch)
    return int(_SYMBOLS[code]) if code < 0x250 else 27 + code % 5


def _spelled(path: tuple | None) -> str:
    """The letters of a chain whose last one comes first."""
    out = []
    while path is not None:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def _as_letters(word: str, model: np.ndarray) -> list[str]:
    """Readings of plain letters: as they stand, and if one is doubled, the likeliest word and
    each word with one doubled letter taken back."""
    if not DOUBLE.search(word):
        return [word]
    found = [word, restore(word, model)]
    if len(word) <= LONGEST_WORD and not RUN.search(word):
        found += [word[: m.start()] + word[m.start() + 1:] for m in DOUBLE.finditer(word)]
    return list(dict.fromkeys(found))


def _readings(token: str, model: np.ndarray) -> list[str]:
    """Plain words that a token without white space may stand for."""
    core = token.rstrip(TAIL)
    if core.isalpha() and not RUN.search(core):
        return _as_letters(core, model)
    core = RULED_TAIL.sub("", core).rstrip(TAIL)
    if core.isalpha() and not RUN.search(core):
        return _as_letters(core, model)
    found = [core, restore(core, model)] if core else []
    inner = core.strip("(¡¿\"'«„“[{<#*%&~=_-/").rstrip(TAIL)
    if inner != core and inner:
        found += _as_letters(inner, model) if inner.isalpha() else [inner, restore(inner, model)]
    for part in re.split(r"[^\w@$!|+]+", core):
        if part and part != core and part != inner:
            found += _as_letters(part, model) if part.isalpha() else [restore(part, model)]
    return found


def _spaced_words(run: str, model: np.ndarray, longest: int = LONGEST_WORD) -> Iterator[str]:
    """What a run of spaced letters may hold: its ends as closed words of up to ``longest``
    letters, and from every other place the beginning of a word, as far as stems go."""
    joined = "".join(run.split())
    plain = joined.isalpha() and not RUN.search(joined)
    longest = max(longest, STEMS[-1])
    for whole in _as_letters(joined, model) if plain else [restore(joined, model)]:
        cut = max(0, len(whole) - longest)
        yield from (whole[i:i + STEMS[-1]] + OPEN for i in range(cut))
        yield from (whole[i:] for i in range(cut, len(whole) - 2))


def restored_words(text: str, model: np.ndarray, memory: dict[str, list[str]] | None = None) -> set[str]:
    """The distinct words of a text, each as restored."""
    memory = {} if memory is None else memory
    low, words = text.lower(), set()
    for token in set(low.split()):
        if token not in memory:
            memory[token] = _readings(token, model)
        words.update(memory[token])
    for run in SPACED.findall(low):
        words.update(_spaced_words(run, model))
    return words


def features(word: str) -> list[str]:
    """A word's stems (open at the end) and the word itself (closed)."""
    stems = [word[:n] for n in STEMS if len(word) > n]
    return stems if word.endswith(OPEN) else [*stems, f"{word} "]


@dataclass
class ToxicityModel:
    language: np.ndarray
    weights: dict[str, float]
    base: float
    _scores: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._longest = max(map(len, self.weights), default=0)

    def score(self, text: str) -> float:
        seen, hits = self._scores, set()
        low = text.lower()
        for token in set(low.split()):
            found = seen.get(token)
            if found is None:
                if len(seen) >= CACHE_WORDS:
                    seen.clear()
                found = seen[token] = self._hits(_readings(token, self.language))
            if found:
                hits.update(found)
        for run in SPACED.findall(low):
            hits.update(self._hits(_spaced_words(run, self.language, self._longest)))
        return 1.0 - (1.0 - self.base) * math.prod(1.0 - self.weights[h] for h in hits)

    def _hits(self, words) -> tuple[str, ...]:
        return tuple({f for w in words for f in features(w) if f in self.weights})


@dataclass(frozen=True)
class ToxicRow:
    """What learning needs of a toxic row: a place in the order of rows, marks of its words, and
    those of its features that can be learned at all."""

    place: str
    marks: tuple[int, ...]
    features: frozenset[str]


def marks_of(words: set[str]) -> list[int]:
    """Four smallest hashes of the words."""
    return [min((zlib.crc32(w.encode(), seed) for w in words), default=0) for seed in (1, 77, 4099, 65537)]


def distinct_rows(rows: list[ToxicRow]) -> list[frozenset[str]]:
    """The features of one row of each group of copies: rows that share 3 of 4 smallest hashes are copies."""
    seen: set[tuple] = set()
    kept = []
    for row in sorted(rows, key=lambda r: (r.place, r.marks)):
        marks = {(skip, *row.marks[:skip], *row.marks[skip + 1:]) for skip in range(4)}
        if not marks & seen:
            kept.append(row.features)
        seen |= marks
    return kept


def _specific(weights: dict[str, float], where: dict[str, set[int]]) -> dict[str, float]:
    """``weights`` without stems that longer features explain.

    ``path`` tells no more than ``pathetic`` does, but clean words begin like that too.  A stem stays
    if it is a sure word itself, so that its endings are found, or if some row has it in no
    longer sure feature.
    """
    longer: dict[str, set[int]] = {}
    for f in weights:
        for n in STEMS:
            if n < len(f.rstrip()):
                longer.setdefault(f[:n], set()).update(where[f])
            elif n == len(f.rstrip()) and f.endswith(" "):
                longer.setdefault(f[:n], set()).update(where[f])
    return {f: w for f, w in weights.items()
            if f.endswith(" ") or f"{f} " in weights or not where[f] <= longer.get(f, set())}


def cover(toxic: list[frozenset[str]], clean: Counter, n_clean: int) -> tuple[dict[str, float], float]:
    """Features by sequential covering: ``(feature -> chance of toxic, rest)``; ``toxic`` are features by row.

    First come the features that are sure on all rows, by cautious precision ``t / (t + c + 2)``.
    Then the best feature for the rows still unexplained is taken, these are set aside, and so on
    while its precision there is at least ``ACCEPT``: a word that merely stands beside an
    explained one gathers little evidence.
    """
    where: dict[str, set[int]] = {}
    for i, own in enumerate(toxic):
        for f in own:
            where.setdefault(f, set()).add(i)
    value = lambda f: len(where[f]) / (len(where[f]) + clean.get(f, 0) + 2)
    weights = _specific({f: value(f) for f in where if value(f) >= SURE}, where)
    left = set(range(len(toxic))).difference(*[where[f] for f in weights])
    for f in where:
        where[f] &= left
    heap = [(-value(f), f) for f in where if value(f) >= ACCEPT]
    heapq.heapify(heap)
    while heap and left:
        old, f = heapq.heappop(heap)
        where[f] &= left
        now = value(f)
        if now < ACCEPT:
            continue
        if now < -old:
            heapq.heappush(heap, (-now, f))
            continue
        weights[f] = now
        left -= where[f]
    return weights, min(0.5, (len(left) + 0.5) / (len(left) + n_clean + 1))


def _counts(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame({"feature": list(counts), "n": list(counts.values())}).astype({"feature": "object", "n": "int64"})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out third.

    The language model is counted over all of ``docs``.  Without labels of a kind every text
    gets the base score.
    """
    spark = docs.sparkSession
    language = language_model(docs)
    shared = spark.sparkContext.broadcast(language)
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
              .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # The sample is bounded by its parameter, so it may be sent to the documents.
    rows = materialize(id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text"))
    bad, good = rows.where("toxic = 1"), rows.where("toxic = 0")

    def counted(known: Broadcast | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Rows by feature, of all features or of the known ones; '' counts the rows themselves."""
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memory: dict[str, list[str]] = {}
            counts: Counter = Counter()
            for batch in batches:
                for text in batch["text"]:
                    found = {f for w in restored_words(text, shared.value, memory) for f in features(w)}
                    counts.update(found if known is None else found & known.value)
                    counts[""] += 1
                    if len(counts) > COUNTED_FEATURES:
                        yield _counts(counts)
                        counts = Counter()
            yield _counts(counts)
        return count

    schema = "feature string, n bigint"
    by_feature = lambda frame, known: frame.mapInPandas(counted(known), schema).groupBy("feature").agg(F.sum("n").alias("n"))
    # A feature needs t / (t + 2) >= ACCEPT toxic rows even without a clean one: the rest stays away from the driver.
    often = by_feature(bad, None).where((F.col("feature") != "") & (F.col("n") >= ACCEPT * (F.col("n") + 2)))
    able = spark.sparkContext.broadcast(frozenset(r["feature"] for r in often.toLocalIterator()))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, list[str]] = {}
        for batch in batches:
            words = [restored_words(t, shared.value, memory) for t in batch["text"]]
            yield pd.DataFrame({"place": ["\n".join(heapq.nsmallest(50, ws)) for ws in words], "marks": [marks_of(ws) for ws in words],
                                "features": [sorted({f for w in ws for f in features(w)} & able.value) for ws in words]})

    told = bad.mapInPandas(described, "place string, marks array<bigint>, features array<string>")
    names = {f: f for f in able.value}
    toxic = distinct_rows([ToxicRow(r["place"], tuple(r["marks"]), frozenset(names[f] for f in r["features"])) for r in told.toLocalIterator()])
    clean = {r["feature"]: r["n"] for r in by_feature(good, able).toLocalIterator()}
    weights, base = cover(toxic, Counter(clean), clean.get("", 0))
    return ToxicityModel(language, weights, base)


def scorer(spark: SparkSession, model: ToxicityModel) -> Callable[[Column], Column]:
    """A column function text -> score; a null text scores like an empty one."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([own.score(t or "") for t in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts get the base score.  Repeated rows are scored alike, ids are never
    read by the score; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    score = scorer(spark, train(docs, labels))
    return (id_and_text(docs).select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(score(F.col("text")) < threshold)
