"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector over hashed text features and
ordered thresholds. Gives the expected grade and the probability of the top grade.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import bounded_sample, extended, sliced

DIM = 1 << 16
CACHED_WORDS = 150_000
_CORE = re.compile(r"^\W*(.*?)(\W*)$", re.S)


def word_buckets(word: str) -> tuple[int, int]:
    """Buckets of a word itself, lower-cased without punctuation, and of its shape."""
    m = _CORE.match(word)
    core, tail = m[1], m[2]
    case = "d" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core else "-"
    size = min(9, len(core) // 3)
    return zlib.crc32(b"w" + core.lower().encode()) & (DIM - 1), zlib.crc32(f"s{case}{size}{tail[:3]}".encode()) & (DIM - 1)


class _Cache(dict):
    def __missing__(self, word: str) -> tuple[int, int]:
        x = word_buckets(word)
        if len(self) < CACHED_WORDS:
            self[word] = x
        return x


_cache = _Cache()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: damped shares of its words and of their shapes,
    and coarse facts of the whole: its commonest word, distinct words, immediate repeats, length."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = Counter(words)
    pairs = np.array([_cache[w] for w in counts], np.int64)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    buckets, inverse = np.unique(np.concatenate([pairs[:, 0], pairs[:, 1]]), return_inverse=True)
    share = np.bincount(inverse, np.concatenate([n, n])) / len(words)
    whole = {
        "most": n.max() / len(words),
        "distinct": len(n) / len(words),
        "twice": sum(map(str.__eq__, words, words[1:])) / len(words),
        "length": np.log2(len(words)) / 20,
    }
    extra = [zlib.crc32(f"t{k}{int(20 * v)}".encode()) & (DIM - 1) for k, v in whole.items()]
    return np.concatenate([buckets, extra]), np.concatenate([np.log1p(500 * share) / 6, np.full(len(extra), 0.5)])


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    grades: list[float]

    def score(self, text: str | None) -> tuple[float, float]:
        """(expected grade, probability of the top grade)."""
        b, x = features(text)
        above = 1 / (1 + np.exp(-(self.weights[b] @ x - self.thresholds)))
        return float(self.grades[0] + np.diff(self.grades) @ above), float(above[-1]) if len(above) else 1.0


def train(texts: list[str], grades: list[float], steps: int = 200, rate: float = 0.2, decay: float = 5e-5) -> Ordinal:
    """Fit by Adam on the log-likelihood, the grades weighted to count alike."""
    levels = sorted(set(grades))
    if len(levels) < 2:
        return Ordinal(np.zeros(DIM), np.zeros(0), levels or [0.0])
    y = np.searchsorted(levels, grades)
    feats = [features(t) for t in texts]
    size = np.array([len(b) for b, _ in feats])
    rows = np.repeat(np.arange(len(texts)), size)
    used, flat = np.unique(np.concatenate([b for b, _ in feats]), return_inverse=True)
    values = np.concatenate([x for _, x in feats])
    weight = (len(y) / len(levels) / np.bincount(y))[y] / len(y)
    k = len(levels) - 1
    w = np.zeros(len(used))
    base, gaps = -1.0, np.zeros(k - 1)  # thresholds: base, then base plus positive gaps
    state = [np.zeros(len(used) + k), np.zeros(len(used) + k)]
    for step in range(1, steps + 1):
        theta = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.bincount(rows, w[flat] * values, len(y))[:, None] - theta
        p = np.concatenate([np.ones((len(y), 1)), 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.zeros((len(y), 1))], 1)
        slope = p[:, 1:-1] * (1 - p[:, 1:-1])
        own = np.maximum(p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1], 1e-9)
        # d log(P(> y-1) - P(> y)): plus the slope at the lower threshold, minus at the upper
        g = np.zeros((len(y), k))
        low, high = y > 0, y < k
        g[np.flatnonzero(low), y[low] - 1] += slope[np.flatnonzero(low), y[low] - 1] / own[low]
        g[np.flatnonzero(high), y[high]] -= slope[np.flatnonzero(high), y[high]] / own[high]
        g *= -weight[:, None]
        dz = g.sum(1)
        dtheta = -g.sum(0)
        grad = np.concatenate([
            np.bincount(flat, dz[rows] * values, len(used)) + decay * w,
            [dtheta.sum()],
            np.cumsum(dtheta[::-1])[::-1][1:] * np.exp(gaps),
        ])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad * grad
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(used)]
        base -= move[len(used)]
        gaps -= move[len(used) + 1 :]
    weights = np.zeros(DIM)
    weights[used] = w
    return Ordinal(weights, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), [float(x) for x in levels])


def fit(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    rows_per_grade: int = 1500, bytes_per_grade: int = 1 << 24, max_grades: int = 64,
) -> Ordinal:
    """Train on a sample of the rated documents: of each grade ``rows_per_grade`` whole texts at most, lowest hash first, and
    no more once they have ``bytes_per_grade`` bytes.

    Ratings without id or grade and documents without id or text are left out. An id rated twice counts for each of its
    grades, equal rows count once, and of documents with the same id each is an example. What is broadcast and what
    comes to the driver has those bounds whatever the input. More than ``max_grades`` grades raise ValueError;
    without ratings the model gives every text 0 and 1.
    """
    rated = ratings.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{grade_col}`").cast("double").alias("_g")).filter("_i is not null and _g is not null")
    chosen = bounded_sample(rated, F.col("_g"), F.lit(None), F.col("_i").cast("string"), rows_per_grade, bytes_per_grade, max_grades)
    if not chosen:
        return train([], [])
    pairs = [(i, g) for g, ids in chosen.items() for i in ids]  # rows_per_grade x max_grades at most
    asked = docs.sparkSession.createDataFrame(pairs, "_i string, _g double")
    text = docs.select(F.col(f"`{id_col}`").cast("string").alias("_d"), F.col(f"`{text_col}`").alias("_t"))
    joined = text.join(F.broadcast(asked), F.col("_d") == F.col("_i"))
    found = bounded_sample(joined, F.col("_g"), F.col("_i"), F.col("_t"), rows_per_grade, bytes_per_grade, max_grades)
    grades = sorted(found)
    return train([t for g in grades for t in found[g]], [g for g in grades for _ in found[g]])


def score_quality(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns: expected_grade, tail_probability.

    Reads the whole text. A null or empty text has no feature and gets what the thresholds
    alone say. Ids are not used, so null and repeated ones are carried through; an empty table gives an empty result.
    Input columns with the names of added ones give way to them.
    """
    import pyarrow as pa

    docs = docs.drop("expected_grade", "tail_probability")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = [held.value.score(t) for t in b.column(at).to_pylist()]
            cols = [b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array([g[k] for g in got], pa.float64()) for k in (0, 1)]], [*names, "expected_grade", "tail_probability"])

    return docs.mapInArrow(run, extended(docs.schema, "expected_grade double, tail_probability double"))
