"""A quality classifier: document statistics and histogram gradient-boosted trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

FIT_ROWS = 30_000  # labelled rows the trees are fitted on, at most
BINS, DEPTH, TREES, RATE, LEAST = 48, 4, 80, 0.15, 20.0

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 outside ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6

FEATURES = [
    "log_bytes", "log_words", "lower", "upper", "digit", "blank", "mark", "symbol", "wide", "word_mean", "word_spread", "word_max",
    "distinct_words", "top_word", "distinct_pairs", "lines", "distinct_lines", "line_mean", "line_spread", "ended_lines", "capital_words",
    "marked_words", "shouts", "pipes", "short_words", "entropy",
]


def statistics(text: str | None) -> list[float]:
    """One number for each of ``FEATURES``; a null or empty text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    freq = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds, size = np.bincount(_CLASS, freq, 8), len(raw)
    share = freq[freq > 0] / size
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    spans = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    counts = Counter(words)
    ends = b".!?:;\")"
    return [
        np.log1p(size), np.log1p(len(words)), *(kinds[1:8] / size), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(counts) / n, max(counts.values(), default=0) / n, len(set(zip(words, words[1:], strict=False))) / n,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), np.log1p(spans.mean()), np.log1p(spans.std()),
        sum(x[-1] in ends for x in lines) / max(1, len(lines)), sum(w[0] - 65 < 26 and w[0] > 64 for w in counts) / max(1, len(counts)),
        sum(33 <= w[-1] <= 47 or 58 <= w[-1] <= 64 for w in counts) / max(1, len(counts)), freq[33] / n, freq[124] / n,
        float((lengths <= 3).mean()), float(-(share * np.log2(share)).sum()),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees as arrays: node k has the children 2k + 1 and 2k + 2; ``value`` is by leaf."""

    feature: np.ndarray  # (tree, inner node)
    threshold: np.ndarray
    value: np.ndarray  # (tree, leaf)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1.0 / (1.0 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Gradient boosting on the logistic loss, grown level by level on histograms of gradients."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(1) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1) if len(y) else np.zeros((0, x.shape[1]), int)
    feature, threshold = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    value, total = np.zeros((TREES, leaves)), np.full(len(y), base)
    for t in range(TREES if len(y) else 0):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            here, best = node - first, [(1e-6, 0, np.inf)] * width
            for f, e in enumerate(edges):
                key, cells = here * (BINS + 1) + binned[:, f], width * (BINS + 1)
                gl = np.bincount(key, g, cells).reshape(width, -1).cumsum(axis=1)
                hl = np.bincount(key, h, cells).reshape(width, -1).cumsum(axis=1)
                cl = np.bincount(key, minlength=cells).reshape(width, -1).cumsum(axis=1)
                gt, ht, ct = gl[:, -1:], hl[:, -1:], cl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(cl < LEAST) | (ct - cl < LEAST)] = -1
                for k, j in enumerate(gain[:, : len(e)].argmax(axis=1)):
                    if gain[k, j] > best[k][0]:
                        best[k] = (gain[k, j], f, e[j])
            for k, (_, f, at) in enumerate(best):
                feature[t, first + k], threshold[t, first + k] = f, at
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        total += value[t][leaf]
    return Forest(feature, threshold, value, base)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``statistics`` (array of double) of every whole text; rows as they are."""
    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = frame.select("doc_id").schema.add("statistics", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[float(v) for v in statistics(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "statistics"])

    return frame.mapInArrow(run, out)


def fit(measured: DataFrame, labels: DataFrame, train: Column, label: str = "quality", fit_rows: int = FIT_ROWS) -> Forest:
    """Trees from the labelled rows that ``train`` marks, ``fit_rows`` of them by a hash of doc_id.

    Labels other than 0 and 1 are left out, and so is a document whose labels differ.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    rows = measured.filter(train).join(own, "doc_id").select("statistics", "y", F.xxhash64("doc_id").alias("at"))
    sample = rows.orderBy("at").limit(fit_rows).collect()
    x = np.array([r["statistics"] for r in sample]).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r["y"] for r in sample], float))


def score(measured: DataFrame, forest: Forest) -> DataFrame:
    """The columns of ``measured`` but statistics, and ``score`` (0 to 1); null statistics count as zeros.

    Without a labelled row every document scores one half.
    """
    columns = [c for c in measured.columns if c not in ("statistics", "score")]
    out = measured.select(*columns).schema.add("score", "double")
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r or [0.0] * len(FEATURES) for r in b.column(len(columns)).to_pylist()]
            got = shared.value.score(np.array(rows).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(got, pa.float64())], names=[*columns, "score"])

    return measured.select(*columns, "statistics").mapInArrow(run, out)
