"""Quality of texts: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import held_out, id_and_text

SAMPLE_ROWS, BINS, TREES, DEPTH, RATE, LEAST_ROWS, PENALTY = 20_000, 64, 80, 4, 0.15, 5, 1.0
THRESHOLD = 0.5
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_deviation", "longest_word", "distinct_words", "top_word",
    "distinct_windows", "upper", "digits", "signs", "bars", "exclamations", "stops", "commas", "spaces", "non_ascii",
    "entropy", "log_lines", "line_bytes", "repeated_lines", "ended_lines", "bullet_lines", "stop_words",
    "words_with_sign", "adjacent_repeats", "upper_words")
STOP_WORDS = frozenset(b"the of and to in is that for with was der die und das von den mit ist ein eine "
                       b"le la les de des et en un une que el los y del se por con una".split())
_CLASS = np.zeros((256, 8))
for _name, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~_+=\\{}[]", b"|", b"!?", b".",
                                  b",;:", b" \t\n\r\x0b\x0c")):
    _CLASS[list(_members), _name] = 1
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")


def statistics(text: str) -> list[float]:
    """The values named in ``STATISTICS``; all 0 for an empty text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = (counts @ _CLASS) / size
    present = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    times = Counter(words)
    windows = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = len(lines)
    signed = sum(t for w, t in times.items() if w.strip(b".,;:!?'\"()-").translate(None, _SIGNS) != w.strip(b".,;:!?'\"()-"))
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(times) / n,
        max(times.values()) / n, windows, *share[:3], *share[3:8], counts[128:].sum() / size,
        float(-(present * np.log(present)).sum()), np.log1p(n_lines), np.log1p(size / n_lines),
        1 - len(set(lines)) / n_lines, sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in lines) / n_lines,
        sum(x.lstrip()[:1] in b"-*" for x in lines) / n_lines,
        sum(times[w] for w in STOP_WORDS if w in times) / n, signed / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(t for w, t in times.items() if w.isupper()) / n]


@dataclass
class Forest:
    """All trees as flat arrays: node i goes to ``left[i]`` if value <= ``cut[i]``, else to the next."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go_right = x[rows, self.feature[at]] > self.cut[at]
            # A leaf points to itself and its cut is infinite.
            at = self.left[at] + go_right
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost trees on logistic loss; every split is read from one histogram per node and feature."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) for j in range(d)] if n else []
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1) if n else np.zeros((0, d), int)
    rate = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate / (1 - rate)))
    margin = np.full(n, base)
    feature, cut, left, value, roots = [], [], [], [], []

    def node() -> int:
        feature.append(0), cut.append(np.inf), left.append(len(left)), value.append(0.0)
        return len(left) - 1

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        roots.append(node())
        open_ = [(roots[-1], np.arange(n))]
        for level in range(depth + 1):
            following = []
            for at, rows in open_:
                g, h = gradient[rows].sum(), hessian[rows].sum()
                value[at] = -RATE * g / (h + PENALTY)
                best = (1e-6, 0, 0)
                if level < depth and len(rows) >= 2 * LEAST_ROWS:
                    place = (binned[rows] + np.arange(d) * BINS).ravel()
                    many = lambda w: np.bincount(place, np.repeat(w, d), d * BINS).reshape(d, BINS).cumsum(1)[:, :-1]
                    gl, hl, nl = many(gradient[rows]), many(hessian[rows]), many(np.ones(len(rows)))
                    gain = gl**2 / (hl + PENALTY) + (g - gl)**2 / (h - hl + PENALTY) - g**2 / (h + PENALTY)
                    gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
                    j, b = divmod(int(gain.argmax()), BINS - 1)
                    best = max(best, (float(gain[j, b]), j, b))
                if best[0] > 1e-6:
                    _, j, b = best
                    feature[at], cut[at] = j, edges[j][b]
                    left[at] = node()
                    node()
                    goes_left = binned[rows, j] <= b
                    following += [(left[at], rows[goes_left]), (left[at] + 1, rows[~goes_left])]
                else:
                    margin[rows] += value[at]
            open_ = following
    return Forest(base, np.array(feature, dtype=np.int64), np.array(cut), np.array(left, dtype=np.int64),
                  np.array(value), np.array(roots, dtype=np.int64), depth)


def _measure(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], dtype=float).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out third."""
    chosen = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
              .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
              .dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    # The sample is bounded by its parameter, so it may be sent to the documents.
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": list(_measure(batch["text"]))})

    found = rows.mapInPandas(measured, "doc_id bigint, quality int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), dtype=float).reshape(-1, len(STATISTICS))
    return fit(x, found["quality"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts have all statistics 0 and get the score of such a text.  Repeated rows
    are scored alike; ids, languages and sources are never read by the score; without labels of
    both kinds every text gets the base rate; an empty table gives no rows.
    """
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(forest.value.predict(_measure(texts)))

    return (id_and_text(docs).select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
