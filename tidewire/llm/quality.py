"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a vector of smoothed, transformed ratios.  Class means and
covariances come from sums over every labelled training row, added up by Spark's
own aggregates; covariances are shrunk towards the pooled one and its diagonal.  A score is
the sigmoid of the difference of the two Gaussian log densities, computed from
Cholesky factors that are inverted once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stage, table
from .textnum import Words, mix, slices, tidy

FEATURES = ("words", "word_size", "symbols", "capitals", "marks", "digits", "new_pairs", "new_words", "stutter", "line_words")
#: Shares of the shrunk covariance that come from the pooled one and from its diagonal.
POOLED, DIAGONAL = 0.15, 0.15
#: Log densities are divided by this, as features are not independent draws of a Gaussian.
TEMPER = 3.0
THRESHOLD = 0.3


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _kind("#*$%&|<>^~`{}[]\\@=+_")
_CAPITAL = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _kind("!?")
_DIGIT = _kind("0123456789")


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text.

    Ratios are smoothed by some words of ordinary text, so that short texts are
    taken for ordinary ones; null and empty texts are only that.
    """
    rows = len(column)
    w = Words(column)
    doc = w.doc
    n = np.bincount(doc, minlength=rows).astype(float) if len(doc) else np.zeros(rows)
    out = np.zeros((rows, len(FEATURES)))

    def chars(kind: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(kind[w.data])]
        return (run[w.off[1:]] - run[w.off[:-1]]).astype(float)

    size = (np.bincount(doc, w.end - w.start, rows) if len(doc) else np.zeros(rows)) if rows else np.zeros(0)
    same = (doc[1:] == doc[:-1]) if len(doc) else np.empty(0, bool)
    pair = mix(w.hash[1:] * np.uint64(31) + w.hash[:-1], 9)[same] if len(doc) else np.empty(0, np.uint64)
    at = doc[1:][same] if len(doc) else doc

    def different(key: np.ndarray, of: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(rows)
        order = np.lexsort((key, of))
        k, o = key[order], of[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]
        return np.bincount(o[new], minlength=rows).astype(float)

    pairs = np.maximum(n - 1, 0)
    stutter = np.bincount(doc[1:][same & (w.hash[1:] == w.hash[:-1])], minlength=rows).astype(float) if len(doc) else np.zeros(rows)
    lines = 1 + chars(_kind("\n"))
    short = 12.0
    out[:, 0] = np.log(n + short)
    out[:, 1] = np.log((size + 5 * short) / (n + short))
    out[:, 2] = np.log((chars(_SYMBOL) + 0.4) / (n + short) + 0.02)
    out[:, 3] = np.log((chars(_CAPITAL) + 0.08 * 5 * short / 4) / (size + 5 * short) + 0.01)
    out[:, 4] = np.log((chars(_MARK) + 0.1) / (n + short) + 0.02)
    out[:, 5] = np.log((chars(_DIGIT) + 0.1) / (size + 5 * short) + 0.05)
    out[:, 6] = np.log(1.05 - (different(pair, at) + short) / (pairs + short))
    out[:, 7] = np.log((different(w.hash, doc) + short) / (n + short))
    out[:, 8] = np.log((stutter + 0.1) / (pairs + short) + 0.02)
    out[:, 9] = np.log((n + 2 * short) / (lines + 1))
    return out


@tidy
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1)):
            part = batch.slice(a, b - a)
            x = features(part.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


class Discriminant:
    """Means, inverse Cholesky factors and log constants of both classes."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        mean = sums / counts[:, None]
        cov = squares / counts[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (counts[:, None, None] * cov).sum(0) / counts.sum()
        diag = np.diag(np.diag(pooled) + 1e-6)
        self.mean, self.factor, self.constant = mean, [], []
        for k in (0, 1):
            c = (1 - POOLED - DIAGONAL) * cov[k] + POOLED * pooled + DIAGONAL * diag
            low = np.linalg.cholesky(c)
            self.factor.append(np.linalg.inv(low))
            self.constant.append(np.log(counts[k] / counts.sum()) - np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.mean, self.factor, self.constant)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPER, -30, 30)))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row."""
    return docs.select("doc_id", "text").mapInArrow(_feature_batches, "doc_id long, x array<double>")


def train(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The model from all rows of ``labels`` (doc_id, label 0 or 1); None if a class has no rows."""
    known = stats.join(labels.filter("label in (0, 1)"), "doc_id").select(F.col("label").cast("int").alias("label"), "x")
    d = len(FEATURES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    total, square = np.zeros((2, 1 + d)), np.zeros((2, d, d))
    for r in known.groupBy("label").agg(F.count("*"), *(F.sum(v) for v in x), *(F.sum(x[i] * x[j]) for i, j in pairs)).collect():  # two rows at most
        total[r[0]] = r[1 : 2 + d]
        for (i, j), v in zip(pairs, r[2 + d :]):
            square[r[0], i, j] = square[r[0], j, i] = v
    if (total[:, 0] < 1).any():
        return None
    return Discriminant(total[:, 0], total[:, 1:], square)


def _score_batches(shared) -> object:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return run


def score(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score) of each row of statistics; without a model every score is 0.5."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    shared = stats.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return stats.mapInArrow(_score_batches(shared), "doc_id long, score double")


def held_out():
    """Rows never trained on: crc32 of doc_id as text is a multiple of 5."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant | None]:
    """Staged statistics of ``docs``, and the model from those of ``labels`` (doc_id, quality) that aren't held out."""
    stats = stage(statistics(docs), "statistics")
    return stats, train(stats, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))


def _scorer(shared) -> object:
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pickle.loads(shared.value)
        for text in texts:
            yield pa.array(np.concatenate([model.score(features(text.slice(a, b - a))) for a, b in slices(text)] or [np.empty(0)]))

    return F.arrow_udf(run, "double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches THRESHOLD, with their columns; all of them if there is no model.

    A first pass sums statistics, of which only numbers are shuffled; a second
    scores every text where it is read, so no text is written twice.
    """
    model = train(statistics(docs), labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")))
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return docs.filter(_scorer(shared)(F.col("text")) >= THRESHOLD)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; null and empty texts are scored as ordinary short ones.

    Equal texts have equal scores, repeated rows return as often as they come, an
    empty table gives no rows, and other columns are ignored.
    """
    stats, model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    s = score(stats, model)
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
