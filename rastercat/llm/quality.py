"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and towards its diagonal. The
Cholesky factor of each is inverted once; a document's score is the logistic of the difference of
two Mahalanobis log densities plus the log prior odds, shifted so that 0.5 parts the labelled rows
with the fewest errors.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, the first by a hash of the
id); all documents are scored. Statistics are of whole texts.

Defined cases: null and empty texts have the statistics of an empty text and get a score; unlabelled
and null-labelled rows are not learned from; with one class or none every score is that class (1
with none); repeated rows are scored each. doc_id, lang, source and labels are no inputs of a score.
``accepted``, ``scored`` and ``with_statistics`` carry all columns of docs, whatever their names (the
new column of the latter two must not be one of them); doc_id may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastercat.llm import textbytes as tb
from rastercat.llm.storage import column, kinds, mapped, unused

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 12_000
SHRINK_TO_POOLED = 0.1
SHRINK_TO_DIAGONAL = 0.1

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sign
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[32, 9, 11, 12, 13]], _KIND[10] = 4, 5
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 6
_COMMON_SIGNS = np.zeros(256, bool)
_COMMON_SIGNS[[*b".,;:'\"?!-()"]] = True

FEATURES = (
    "log bytes", "log words", "mean word length", "spread of word lengths", "upper share", "digit share", "sign share", "odd sign share", "non-ASCII share",
    "log line length", "different words", "different pairs", "different lines", "most frequent word", "longest word", "bar share", "words that end in a sign", "exclamation share",
)


def _starts_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each document."""
    n = len(offsets) - 1
    kind = _KIND[data]
    size = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(FEATURES)), np.float64)
    starts, ends = tb.word_spans(data, offsets, ~tb.SPACES)
    bounds = tb.counts_in(offsets, starts)
    words = np.maximum(np.diff(bounds), 1)
    lengths = (ends - starts).astype(np.float64)
    mean = _starts_sums(lengths, bounds) / words
    share = lambda mask: _starts_sums(mask, offsets) / size
    sign = kind == 6
    lines = _starts_sums(kind == 5, offsets) + 1
    out[:, 0], out[:, 1], out[:, 2] = np.log(size), np.log(words), mean
    out[:, 3] = np.sqrt(np.maximum(_starts_sums(lengths**2, bounds) / words - mean**2, 0))
    odd = sign & ~_COMMON_SIGNS[data]
    for k, mask in ((4, kind == 2), (5, kind == 3), (6, sign), (7, odd), (8, data >= 128), (15, data == 124), (17, data == 33)):
        out[:, k] = np.log(share(mask) + 1e-3)
    out[:, 9] = np.log(size / lines)
    if len(ends):
        out[:, 16] = np.log(_starts_sums(sign[ends - 1], bounds) / words + 1e-2)
    else:
        out[:, 16] = np.log(1e-2)
    hashes = tb.span_hashes(tb.prefix_sums(data), starts, ends)
    pairs = tb.sequence_hashes(hashes, 2)
    line_starts, line_ends = tb.word_spans(data, offsets, np.arange(256) != 10)
    line_bounds = tb.counts_in(offsets, line_starts)
    line_hashes = tb.span_hashes(tb.prefix_sums(data), line_starts, line_ends)
    for i in range(n):
        own = hashes[bounds[i] : bounds[i + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            out[i, 10], out[i, 13] = len(counts) / len(own), np.log(counts.max() / len(own))
            out[i, 14] = np.log(lengths[bounds[i] : bounds[i + 1]].max())
            out[i, 11] = (len(np.unique(pairs[bounds[i] : bounds[i + 1] - 1])) + 1) / len(own)
            own = line_hashes[line_bounds[i] : line_bounds[i + 1]]
            out[i, 12] = len(np.unique(own)) / max(len(own), 1)
    return out


class Discriminant:
    """Two shrunken Gaussians with cached inverse Cholesky factors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = SHRINK_TO_POOLED, to_diagonal: float = SHRINK_TO_DIAGONAL):
        self.constant = None
        if len(np.unique(y)) < 2:
            self.constant = float(y[0]) if len(y) else 1.0
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        groups = [z[y == k] for k in (0, 1)]
        pooled = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups) / len(z)
        self.parts = []
        for g in groups:
            own = (g - g.mean(0)).T @ (g - g.mean(0)) / len(g)
            cov = (1 - to_pooled) * own + to_pooled * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.parts.append((g.mean(0), np.linalg.inv(lower).T.copy(), -np.log(np.diag(lower)).sum() + np.log(len(g) / len(z))))
        self.cut = self._cut(self._odds(x), y)

    @staticmethod
    def _cut(odds: np.ndarray, y: np.ndarray) -> float:
        """The log odds that part the labelled rows with the fewest errors, in the middle of their gap."""
        order = np.argsort(odds, kind="stable")
        odds, y = odds[order], y[order]
        errors = np.concatenate([[0], np.cumsum(y == 1)]) + np.concatenate([np.cumsum((y == 0)[::-1])[::-1], [0]])
        k = int(np.argmin(errors))
        return float((odds[max(k - 1, 0)] + odds[min(k, len(odds) - 1)]) / 2)

    def _odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        low, high = (bias - 0.5 * (((z - mean) @ inverse) ** 2).sum(1) for mean, inverse, bias in self.parts)
        return high - low

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._odds(x) - self.cut, -100, 100) / 4))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text and extra columns of docs as they are, with ``statistics`` array<double>."""
    return _mapped(docs, "statistics", "array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64())))


def _mapped(docs: DataFrame, name: str, kind: str, made) -> DataFrame:
    names, at = docs.columns, docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(at))
            rows = [statistics(part, at_) for _, _, part, at_ in tb.pieces(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, made(np.concatenate(rows) if rows else np.zeros((0, len(FEATURES))))], names=[*names, name])

    return mapped(docs, work, [*names, name], [*kinds(docs), kind])


def sampled_labels(labels: DataFrame, label: str, learnable: Column, sample: int) -> DataFrame:
    """At most ``sample`` labelled ids, the first by a hash; one label an id."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.max(label).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Discriminant:
    """``learnable`` tells by doc_id which labelled rows may be learned from."""
    chosen = sampled_labels(labels, "quality", learnable, sample)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_statistics(rows).select("doc_id", "label", "statistics").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["statistics"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    return Discriminant(x, got["label"].to_numpy(np.int64))


def scored(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """docs with the model's score, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _mapped(docs, name, "double", lambda x: pa.array(shared.value.scores(x), pa.float64()))


def third(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier takes for good ones."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), F.coalesce(third() != 1, F.lit(False)), sample)
    (score,) = unused(docs, "score")
    return scored(docs, model, score).filter(F.col(score) >= 0.5).select(*(column(c) for c in docs.columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, third() != 1)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
