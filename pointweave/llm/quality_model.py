"""Operator 1: histogram gradient-boosted trees over document statistics, scored by flat arrays in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm.common import in_batches, named

#: Labelled rows that a model is fitted on, at most: those of least hash, so the sample is the same on every run.
SAMPLE_ROWS = 20_000
FOLDS, PREDICT_FROM = 5, 0.3
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 80, 4, 0.15, 64, 20, 1.0

UPPER, DIGIT = slice(65, 91), slice(48, 58)
SYMBOLS, STOPS, SPACES = (np.frombuffer(s, np.uint8) for s in (b"#*$%&|<>", b".,;:?", b" \t\n\v\f\r"))
STATISTICS = ("log_bytes", "log_words", "word_bytes", "word_bytes_sd", "distinct_words", "top_word", "same_next", "distinct_pairs", "upper", "digit", "symbol", "exclaim", "stop", "high_byte", "space", "lines_a_word", "repeated_lines", "byte_entropy", "longest_word")


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of one whole text; an empty or null text is all zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    words, n = text.split(), len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = count[count > 0] / n
    many = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split(b"\n")
    top = Counter(words).most_common(1)[0][1] if words else 0
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), len(set(words)) / many, top / many, sum(map(eq, words, words[1:])) / many,
        len(set(zip(words, words[1:], strict=False))) / many, count[UPPER].sum() / n, count[DIGIT].sum() / n, count[SYMBOLS].sum() / n, count[33] / n, count[STOPS].sum() / n,
        count[128:].sum() / n, count[SPACES].sum() / n, len(lines) / many, 1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(), min(sizes.max(), 1000.0),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees in level order: node i has children 2i+1 and 2i+2; rows above the cut go to the second."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted logistic loss; each level of a tree is one histogram of gradients over (node, feature, bin).

    Without rows the score is a half, with one class only that class's smoothed share.
    """
    inner = 2**DEPTH - 1
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate / (1 - rate)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    width = x.shape[1] * BINS
    slot = coded + np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), base)
    grown: tuple[list, list, list] = ([], [], [])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, here = 2**level - 1, 2**level
            key = ((node - first)[:, None] * width + slot).ravel()
            g, h, n = (np.bincount(key, np.repeat(v, x.shape[1]), here * width).reshape(here, x.shape[1], BINS).cumsum(2) for v in (gradient, weight, np.ones(len(y))))
            g_all, h_all, n_all = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(n < LEAST_ROWS) | (n_all - n < LEAST_ROWS)] = 0
            best = gain.reshape(here, -1).argmax(1)
            for i in range(here):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    feature[first + i], cut[first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, gradient, inner + 1) / (np.bincount(at, weight, inner + 1) + RIDGE)
        raw += leaf[at]
        for kept, new in zip(grown, (feature, cut, leaf), strict=True):
            kept.append(new)
    return Forest(*(np.stack(v) for v in grown), base)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's text is a multiple of FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in column.cast(pa.large_binary()).to_pylist()], float).reshape(-1, len(STATISTICS))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold.

    Null labels and ids with both labels teach nothing. The sample is the ids of least hash; rows that repeat an id
    teach once (the least statistics), so ``sample_rows`` bounds what is broadcast and what comes to the driver (its
    statistics, not its texts). Null and empty texts are all zeros; empty tables give a model that scores a half.
    """
    clear = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.min(label_col).alias("pw_low"), F.max(label_col).alias("pw_high"))
    clear = clear.where("pw_low = pw_high").select(id_col, F.col("pw_low").cast("double").alias("pw_label"))
    sample = clear.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("pw_id"), F.col(text_col).alias("pw_text")).join(F.broadcast(sample.withColumnRenamed(id_col, "pw_id")), "pw_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("pw_text"))
            yield pa.RecordBatch.from_arrays([b.column("pw_id"), b.column("pw_label"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("y double, x array<double>").fields])
    got = in_batches(rows, run, out).groupBy("id", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()
    x, y = np.array(got["x"].to_pylist(), float).reshape(-1, len(STATISTICS)), np.array(got["y"].to_pylist(), float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score in 0 to 1, predicted (1 from PREDICT_FROM on).

    Statistics are of the whole text; null and empty texts score alike. Repeated rows give repeated results, empty
    tables empty ones; other columns are not read, and the id is only handed through. A result column that the id has
    the name of gets ``_result`` behind it.
    """
    kind = docs.schema[id_col]
    out = T.StructType([T.StructField("pw_id", kind.dataType), T.StructField("pw_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(forest.scores(_matrix(b.column(text_col))))], names=out.names)

    scored = in_batches(docs.select(id_col, text_col), run, out)
    held, value, predicted = named(id_col, ["held_out", "score", "predicted"])
    return scored.select(F.col("pw_id").alias(id_col), held_out(F.col("pw_id")).alias(held), F.col("pw_score").alias(value), F.when(F.col("pw_score") >= PREDICT_FROM, 1).otherwise(0).alias(predicted))
