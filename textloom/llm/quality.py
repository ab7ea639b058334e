"""Operator 3: quality classifier, a generalised additive model with pairwise interactions.

Texts become FEATURES; each is cut into quantile bins. Cyclic boosting visits one feature after another and adds a shallow tree
over its bins (up to three cuts) to that feature's lookup table, then does the same with a tree of one cut on each axis for the
pairs whose residuals gain most. A score is the sigmoid of the summed table entries of a text's bins.

Learning uses at most `max_labels` labelled rows (a bounded sample in hash order, the documented parameter) of the folds not held
out; several labels of one id count as its lowest; null labels are ignored. Without labels of both classes every score is the
share of label 1 (0.5 without labels). Null texts score as empty ones. Repeated rows are scored each. Only text decides a score.
Label rows go out by a broadcast that `max_labels` bounds; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import fold, slices, table, texts, tidied

FEATURES = (
    "log_chars", "log_words", "word_length", "symbol_share", "digit_share", "upper_share", "distinct_share", "top_share",
    "repeat_share", "bigram_copies", "line_copies", "marked_words", "stops_per_word", "short_share", "bare_words", "top_bigram_share",
)
MAX_LABELS, THRESHOLD = 20_000, 0.3
SYMBOLS, DIGITS, UPPERS, STOPS = (re.compile(p) for p in (r"[^\w\s.,;:!?'\"()-]", r"\d", r"[A-Z]", r"[.!?](?:\s|\Z)"))
EDGES = ".,;:!?'\"()-"


def features(text: str | None) -> list[float]:
    """Shares are of words or characters; an empty text has all zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    low = [w.lower().strip(EDGES) for w in words]
    counts = Counter(low)
    pairs = Counter(zip(low, low[1:], strict=False))
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    symbols = SYMBOLS.findall(text)
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), chars / n, len(symbols) / len(text), len(DIGITS.findall(text)) / len(text),
        len(UPPERS.findall(text)) / len(text), len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, low, low[1:])) / n,
        1 - len(pairs) / (n - 1) if n > 1 else 0.0, 1 - len(set(lines)) / len(lines), sum(not w.isalnum() for w in low) / n,
        len(STOPS.findall(text)) / n, sum(len(w) <= 3 for w in low) / n, counts.get("", 0) / n, max(pairs.values()) / n if pairs else 0.0,
    ]


def _tree(g: np.ndarray, h: np.ndarray, cuts: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the cuts of most gain, one after another."""
    edges = [0, len(g)]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    for _ in range(cuts):
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), m) for a, b in zip(edges, edges[1:], strict=False) for m in range(a + 1, b) if min(H[m] - H[a], H[b] - H[m]) > 1e-3), default=(0, 0))
        if best[0] <= 1e-9:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


class Additive:
    """Lookup tables of single features and of pairs, and the intercept."""

    def __init__(self, bins: int = 32, grid: int = 8, pairs: int = 6, rounds: int = 120, pair_rounds: int = 60, rate: float = 0.15):
        self.bins, self.grid, self.n_pairs, self.rounds, self.pair_rounds, self.rate = bins, grid, pairs, rounds, pair_rounds, rate
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.intercept = 0.0

    @staticmethod
    def _cuts(x: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="higher"))

    def _binned(self, X: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, X[:, j], side="right") for j, e in enumerate(edges)], axis=1)

    def fit(self, X: np.ndarray, y: np.ndarray) -> Additive:
        share = float(y.mean()) if len(y) else 0.5
        self.intercept = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        if len(y) == 0 or share in (0.0, 1.0):
            return self
        d = X.shape[1]
        # rare bad texts sit in the tails: half of the cuts are quantiles of the rarer class
        rare = X[y == (share < 0.5)]
        cut = lambda j, n: np.union1d(self._cuts(X[:, j], n // 2), self._cuts(rare[:, j], n // 2))
        self.edges, self.coarse = [cut(j, self.bins) for j in range(d)], [cut(j, self.grid) for j in range(d)]
        B, C = self._binned(X, self.edges), self._binned(X, self.coarse)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        z = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for j in range(d):
                p = 1 / (1 + np.exp(-z))
                size = len(self.tables[j])
                step = self.rate * _tree(np.bincount(B[:, j], y - p, size), np.bincount(B[:, j], p * (1 - p), size), 3)
                self.tables[j] += step
                z += step[B[:, j]]
        p = 1 / (1 + np.exp(-z))
        gains = []
        for a, b in combinations(range(d), 2):
            size = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
            cell = C[:, a] * size[1] + C[:, b]
            g, h = np.bincount(cell, y - p, size[0] * size[1]), np.bincount(cell, p * (1 - p), size[0] * size[1])
            gains.append((float((g**2 / (h + 1)).sum()), a, b, size, cell))
        chosen = sorted(gains, key=lambda x: -x[0])[: self.n_pairs]
        grids = [np.zeros(c[3]) for c in chosen]
        for _ in range(self.pair_rounds):
            for (_, a, b, size, cell), values in zip(chosen, grids, strict=True):
                p = 1 / (1 + np.exp(-z))
                g, h = np.bincount(cell, y - p, size[0] * size[1]).reshape(size), np.bincount(cell, p * (1 - p), size[0] * size[1]).reshape(size)
                step = self.rate * self._grid_tree(g, h)
                values += step
                z += step.ravel()[cell]
        self.pairs = [(a, b, v) for (_, a, b, _, _), v in zip(chosen, grids, strict=True)]
        return self

    @staticmethod
    def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One cut on each axis, the best of all: four leaves."""
        G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
        part = lambda S, q: (S[1:-1, 1:-1], S[1:-1, -1:] - S[1:-1, 1:-1], S[-1:, 1:-1] - S[1:-1, 1:-1], S[-1:, -1:] - S[1:-1, -1:] - S[-1:, 1:-1] + S[1:-1, 1:-1])[q]
        out = np.zeros_like(g)
        if min(g.shape) < 2:
            return out
        gain = sum(part(G, q) ** 2 / (part(H, q) + 1.0) for q in range(4))
        i, j = (int(k) + 1 for k in np.unravel_index(np.argmax(gain), gain.shape))
        for q, (r, c) in enumerate(((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None)))):
            out[r, c] = part(G, q)[i - 1, j - 1] / (part(H, q)[i - 1, j - 1] + 1.0)
        return out

    def score(self, X: np.ndarray) -> np.ndarray:
        z = np.full(len(X), self.intercept)
        if self.tables:
            B, C = self._binned(X, self.edges), self._binned(X, self.coarse)
            for j, values in enumerate(self.tables):
                z += values[B[:, j]]
            for a, b, values in self.pairs:
                z += values[C[:, a], C[:, b]]
        return 1 / (1 + np.exp(-z))


def _matrix(values: list) -> np.ndarray:
    return np.array([features(t) for t in values], dtype=np.float64).reshape(len(values), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, held_out: int = 0, key: str = "doc_id", text: str = "text", label: str = "quality") -> Additive:
    """Learn from labelled rows outside the held-out fold."""
    wanted = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(held_out))
    sample = wanted.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(_matrix(b.column("text").to_pylist())), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = texts(docs, key, text).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text").mapInArrow(tidied(run), "doc_id long, y int, x array<double>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_labels).toArrow()
    X = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(got.num_rows, len(FEATURES))
    return Additive().fit(X, np.array(got.column("y").to_pylist(), dtype=np.float64))


def scored(df: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """All columns of the rows, and `score` (a column of that name gives way)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop("score")
    where = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            values = shared.value.score(_matrix(b.column(where).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values)], names=[*b.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.mapInArrow(tidied(run), StructType([*df.schema.fields, StructField("score", DoubleType())]))


def kept(df: DataFrame, model: Additive, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, all columns and no other, whose texts score at least the threshold."""
    inner = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(f"`{text}`").alias("text"))
    return scored(inner, model).where(F.col("score") >= threshold).select(*[F.col("doc").getField(c).alias(c) for c in df.columns])


def op3_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(texts(docs), model).select("doc_id", fold(0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
