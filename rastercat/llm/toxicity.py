"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word has the sum of three learned embeddings, hashed from the whole word, its first bytes and its
last bytes. Filters of widths 1, 2 and 3 run over the words of the whole text; each filter's largest
response over the text, rectified, feeds a logistic output. Because a filter's response is a sum of
one term for each word and offset, those terms are tabulated for the embedding tables once the
model is trained, and scoring adds table rows.

Every labelled row that may be learned from trains a model and calibrates the other: rows fall into
two folds by a hash of the id, a model is trained on each, and each model's thresholds are chosen on
all rows of the fold that it has not seen; the score is of the mean of both. Where a fold lacks a
class, one model is trained and calibrated on all rows.

Training goes in ``EPOCHS`` rounds. A fold's rows are dealt into shards of about ``SHARD_ROWS`` by a
hash of the id; in a round each shard passes once over its whole texts from the model so far, and each
parameter row moves by the mean of its changes over the shards that changed it. Sums are of whole
numbers (``UNIT``), so that neither their order nor the layout of files matters. The driver holds the
models, of one size whatever the corpus. A shard of more than ``SHARD_WORDS`` words is passed over in
several parts, none left out.

The threshold is calibrated by language, which function words tell: counts of all rows by model,
language, label and logit (in steps of ``STEP``) give each language's best threshold, which becomes
score 0.5. All documents are scored, over their whole texts.

Defined cases: null and empty texts have no words and get the score of an empty text; null labels
are not learned from; with one class or none, scores are the share of toxic labels (0 with none);
repeated rows are scored each. labels, lang, source and doc_id are no inputs of a score. Only doc_id,
text and toxic are used, so that other columns may have any names; doc_id may be of any type.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.llm import textbytes as tb
from rastercat.llm.storage import dropped, stored

SHARD_ROWS, SHARD_WORDS = 2_500, 4_000_000
CHUNK = 1 << 15
TABLE = 1 << 15
WIDTH = 16
FILTERS = ((1, 6), (2, 4), (3, 4))
EPOCHS, RATE, BATCH = 6, 0.02, 16
PREFIX = SUFFIX = 5
UNIT = float(1 << 24)
STEP = 1 / 1024

MANY = sum(many for _, many in FILTERS)
REACH = max(size for size, _ in FILTERS) - 1
_DENSE = sum(size * WIDTH * many for size, many in FILTERS) + 2 * MANY + 1
DENSE_ROWS = -(-_DENSE // WIDTH)

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

# Frequent function words of four languages, to tell a text's language by.
LANGUAGES = {
    "en": "the of and to in is that it for was on with as",
    "de": "der die und das den mit von ist nicht ein eine auf im zu",
    "fr": "le la les et des est une dans que pour qui du pas sur",
    "es": "el los las y que en del por con una su para lo se",
}


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bounds, words): for each word its rows in the three tables; its full hash."""
    lowered = tb.LOWER[data]
    starts, ends = tb.word_spans(lowered, offsets, _WORD)
    bounds = tb.counts_in(offsets, starts)
    sums = tb.prefix_sums(lowered)
    whole = tb.span_hashes(sums, starts, ends)
    head = tb.span_hashes(sums, starts, np.minimum(starts + PREFIX, ends)) + np.uint64(1)
    tail = tb.span_hashes(sums, np.maximum(ends - SUFFIX, starts), ends) + np.uint64(2)
    mask = np.uint64(TABLE - 1)
    ids = np.stack([(whole & mask).astype(np.int64), ((head >> np.uint64(7)) & mask).astype(np.int64) + TABLE, ((tail >> np.uint64(11)) & mask).astype(np.int64) + 2 * TABLE])
    return ids, bounds, whole


def _language_words() -> tuple[np.ndarray, np.ndarray]:
    names, hashes = [], []
    for k, words in enumerate(LANGUAGES.values()):
        data = np.frombuffer(words.encode(), np.uint8)
        hashes.append(tb.span_hashes(tb.prefix_sums(data), *tb.word_spans(data, np.array([0, len(data)]), _WORD)))
        names.append(np.full(len(hashes[-1]), k))
    hashes, names = np.concatenate(hashes), np.concatenate(names)
    order = np.argsort(hashes)
    return hashes[order], names[order]


def languages(whole: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language of each text by its function words: an index of LANGUAGES."""
    known, names = _language_words()
    at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
    hit = known[at] == whole
    counts = np.zeros((len(bounds) - 1, len(LANGUAGES)))
    for k in range(len(LANGUAGES)):
        total = np.concatenate([[0], np.cumsum(hit & (names[at] == k))])
        counts[:, k] = total[bounds[1:]] - total[bounds[:-1]]
    return counts.argmax(1)


def windows(terms: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The response, without its bias, of each filter from each word on; -inf where the text ends first."""
    n = len(terms)
    out = np.full((n, MANY), -np.inf, np.float32)
    column = filled = 0
    for size, many in FILTERS:
        if n >= size:
            r = terms[: n - size + 1, column : column + many]
            for j in range(1, size):
                r = r + terms[j : n - size + 1 + j, column + j * many : column + (j + 1) * many]
            out[: n - size + 1, filled : filled + many] = r
        for i in range(1, size):
            ends = bounds[1:] - i
            out[ends[(ends >= 0) & (ends < n)], filled : filled + many] = -np.inf
        column, filled = column + size * many, filled + many
    return out


def strongest(terms_of, bounds: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each text's largest response of each filter, without bias, and at which word; ``terms_of(a, b)`` gives words a to b."""
    n, words = len(bounds) - 1, int(bounds[-1])
    top, at = np.full((n, MANY), -np.inf, np.float32), np.full((n, MANY), -1)
    for a in range(0, words, CHUNK):
        b = min(a + CHUNK, words)
        r = windows(terms_of(a, min(b + REACH, words)), bounds - a)[: b - a]
        lo, hi = np.clip(bounds[:-1] - a, 0, b - a), np.clip(bounds[1:] - a, 0, b - a)
        own = np.flatnonzero(lo < hi)
        if places:
            for d in own.tolist():
                part = r[lo[d] : hi[d]]
                k = part.argmax(0)
                best = part[k, np.arange(MANY)]
                better = best > top[d]
                top[d] = np.where(better, best, top[d])
                at[d] = np.where(better, k + lo[d] + a, at[d])
        else:
            top[own] = np.maximum(top[own], np.maximum.reduceat(r, lo[own], axis=0))
    return top, at


class TextCnn:
    """Embedding tables, filters and an output layer; Adagrad, with one sum for each row of the tables, on the rows that a batch touches."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (3 * TABLE, WIDTH)).astype(np.float32)
        self.sums = np.full(3 * TABLE, 1e-6, np.float32)
        dense = [rng.normal(0, 0.3, size * WIDTH * many) for size, many in FILTERS] + [np.zeros(MANY), np.full(MANY, 0.5), [-1.0]]
        self.dense = np.zeros(DENSE_ROWS * WIDTH, np.float32)
        self.dense[:_DENSE] = np.concatenate(dense)
        self.dense_sums = np.full(DENSE_ROWS * WIDTH, 1e-6, np.float32)
        self.terms: np.ndarray | None = None
        self.constant: float | None = None
        self.cuts = np.zeros(len(LANGUAGES))

    def copy(self) -> TextCnn:
        out = object.__new__(TextCnn)
        out.__dict__ = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return out

    @staticmethod
    def _parts(dense: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
        """Filters, biases, output layer and base as views of the dense parameters, or of their gradient."""
        filters, bias, at = [], [], 0
        for size, many in FILTERS:
            filters.append(dense[at : at + size * WIDTH * many].reshape(size, WIDTH, many))
            at += size * WIDTH * many
        ends = at
        for _, many in FILTERS:
            bias.append(dense[ends : ends + many])
            ends += many
        return filters, bias, dense[ends : ends + MANY], dense[ends + MANY : ends + MANY + 1]

    @property
    def filters(self) -> list[np.ndarray]:
        return self._parts(self.dense)[0]

    @property
    def bias(self) -> list[np.ndarray]:
        return self._parts(self.dense)[1]

    @property
    def out(self) -> np.ndarray:
        return self._parts(self.dense)[2]

    @property
    def base(self) -> np.float32:
        return self._parts(self.dense)[3][0]

    def _columns(self) -> np.ndarray:
        """All filters side by side: a column for each filter and offset."""
        return np.concatenate([f[j] for f in self.filters for j in range(len(f))], 1)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> None:
        """texts: word ids (3 x n) of each."""
        if len(np.unique(labels)) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.0
            return
        ids, bounds = np.concatenate(texts, 1), np.cumsum([0, *(x.shape[1] for x in texts)])
        for turn in range(EPOCHS):
            self.epoch(ids, bounds, labels, balance((labels == 0).sum(), (labels == 1).sum()), (seed, turn))

    def epoch(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: tuple[float, float], seed: tuple) -> np.ndarray:
        """One pass over whole texts; how often each row of the tables changed."""
        touched = np.zeros(3 * TABLE, np.int64)
        order = np.random.default_rng(seed).permutation(len(labels))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            part = np.concatenate([ids[:, bounds[d] : bounds[d + 1]] for d in own.tolist()], 1)
            at = np.concatenate([[0], np.cumsum(bounds[own + 1] - bounds[own])])
            touched[self._batch(part, at, labels[own], np.where(labels[own] == 1, weights[1], weights[0]))] += 1
        return touched

    def _vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.embed[ids[0]] + self.embed[ids[1]] + self.embed[ids[2]]

    def _batch(self, ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
        columns = self._columns()
        top, at = strongest(lambda a, b: self._vectors(ids[:, a:b]) @ columns, bounds, places=True)
        filters, bias, out, base = self._parts(self.dense)
        top = np.maximum(top + np.concatenate(bias), 0)
        error = (weight * (1 / (1 + np.exp(-np.clip(top @ out + base, -60, 60))) - labels)).astype(np.float32)
        gradient = np.zeros_like(self.dense)
        g_filters, g_bias, g_out, g_base = self._parts(gradient)
        g_out += error @ top
        g_base += error.sum()
        rows, grads, k = [np.zeros(0, np.int64)], [np.zeros((0, WIDTH), np.float32)], 0
        for f, g_f, g_b in zip(filters, g_filters, g_bias, strict=True):
            many = f.shape[2]
            d, c = np.nonzero(top[:, k : k + many] > 0)
            slope = error[d] * out[k + c]
            np.add.at(g_b, c, slope)
            for j in range(len(f)):
                words = ids[:, at[d, k + c] + j]
                chosen = np.zeros((len(d), many), np.float32)
                chosen[np.arange(len(d)), c] = slope
                g_f[j] += self._vectors(words).T @ chosen
                rows.append(words.ravel())
                grads.append(np.tile(slope[:, None] * f[j].T[c], (3, 1)))
            k += many
        flat, place = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(flat), WIDTH), np.float32)
        np.add.at(total, place.ravel(), np.concatenate(grads))
        self.dense_sums += gradient * gradient
        self.dense -= RATE * gradient / np.sqrt(self.dense_sums)
        self.sums[flat] += (total * total).mean(1)
        self.embed[flat] -= RATE * total / np.sqrt(self.sums[flat])[:, None]
        return flat

    def rows(self) -> np.ndarray:
        """All parameters and their sums as rows of WIDTH + 1 numbers."""
        dense = np.concatenate([self.dense, self.dense_sums]).reshape(-1, WIDTH)
        return np.concatenate([np.concatenate([self.embed, self.sums[:, None]], 1), np.concatenate([dense, np.zeros((len(dense), 1), np.float32)], 1)])

    def moved(self, row: np.ndarray, change: np.ndarray) -> None:
        """Add changes to rows as ``rows`` has them."""
        n = 3 * TABLE
        own = row < n
        self.embed[row[own]] += change[own, :WIDTH]
        self.sums[row[own]] += change[own, WIDTH]
        dense = np.concatenate([self.dense, self.dense_sums]).reshape(-1, WIDTH)
        dense[row[~own] - n] += change[~own, :WIDTH]
        self.dense, self.dense_sums = np.split(dense.ravel(), 2)

    def finish(self) -> None:
        """Tabulate each table row's term in each filter and offset."""
        self.terms = self.embed @ self._columns()
        self.embed = self.sums = self.dense_sums = None

    def logits_of(self, top: np.ndarray) -> np.ndarray:
        return np.maximum(top + np.concatenate(self.bias), 0) @ self.out + self.base

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.zeros(len(bounds) - 1)
        return self.logits_of(strongest(lambda a, b: sum(self.terms[ids[t, a:b]] for t in range(3)), bounds)[0])

    def calibrate(self, logits: np.ndarray, language: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """For each language the threshold with the fewest errors, both classes counting alike; ``counts`` rows have each logit."""
        for k in range(len(self.cuts)):
            own = language == k
            if min(counts[own & (labels == 1)].sum(), counts[own & (labels == 0)].sum()) < 10:
                own = np.ones(len(labels), bool)
            x, place = np.unique(logits[own], return_inverse=True)
            per = [np.bincount(place[labels[own] == y], counts[own][labels[own] == y], len(x)) for y in (0, 1)]
            if not per[0].sum() or not per[1].sum():
                continue
            missed = np.concatenate([[0], np.cumsum(per[1])]) / per[1].sum()
            wrong = np.concatenate([np.cumsum(per[0][::-1])[::-1], [0]]) / per[0].sum()
            loss = missed + wrong
            best = np.flatnonzero(loss <= loss.min() + 1e-12)
            i = int(best[len(best) // 2])
            self.cuts[k] = (x[max(i - 1, 0)] + x[min(i, len(x) - 1)]) / 2


class Scorer:
    """The mean of finished models, each over its thresholds; or a constant."""

    def __init__(self, models: list[TextCnn], constant: float | None = None):
        self.models, self.constant = models, constant

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        ids, bounds, whole = word_ids(data, offsets)
        language = languages(whole, bounds)
        _, first, place = np.unique(whole, return_index=True, return_inverse=True)
        total = np.zeros(len(bounds) - 1)
        for model in self.models:
            terms = sum(model.terms[ids[t, first]] for t in range(3))  # of each distinct word
            total += model.logits_of(strongest(lambda a, b: terms[place[a:b]], bounds)[0]) - model.cuts[language]  # noqa: B023
        return 1 / (1 + np.exp(-np.clip(total / len(self.models), -60, 60)))


def balance(negative: float, positive: float) -> tuple[float, float]:
    """Weights that make both classes count alike."""
    return 0.5 * (negative + positive) / negative, 0.5 * (negative + positive) / positive


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, words: int = SHARD_WORDS, rows: int = SHARD_ROWS) -> Scorer:
    """Learn from all labelled rows that are ``learnable``, which tells by doc_id.

    ``rows`` and ``words`` size the shards, whatever their number; no row is left out.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learnable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    counted = docs.select("doc_id").join(known, "doc_id").groupBy(half.alias("fold"), "label").count().collect()
    counts = np.zeros((2, 2))
    for fold, label, n in counted:
        counts[fold, label] = n
    if not counts.any() or not counts.sum(0).all():
        return Scorer([], float(counts[:, 1].sum() / max(counts.sum(), 1)))
    if not counts.all():
        half, counts = F.lit(0), counts.sum(0, keepdims=True)
    shards = _shards(_packed(docs.filter(learnable)), known, half, math.ceil(counts.sum(1).max() / rows))
    models = [TextCnn() for _ in counts]
    for turn in range(EPOCHS):
        _round(shards, models, [balance(*c) for c in counts], turn, words)
    for model in models:
        model.finish()
    _calibrated(shards, models, words)
    dropped(shards)
    return Scorer(models)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes, deflated: half of what a join would shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            texts = [zlib.compress(data[a:b], 1) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, packed binary")


def _shards(packed: DataFrame, known: DataFrame, fold: Column, many: int) -> DataFrame:
    """fold, shard, label, language and word ids of all rows, stored: the rows of a shard are in one file, in one order.

    The shards are the partitions that the join needs, so that texts are shuffled once.
    """
    names = ["fold", "shard", "label"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(pa.array([zlib.decompress(x) for x in batch.column(3).to_pylist()], pa.large_binary()))
            for i, j, part, at in tb.pieces(data, offsets):
                ids, bounds, whole = word_ids(part, at)
                small = (ids - np.arange(3)[:, None] * TABLE).astype(np.uint16)
                words = pa.array([small[:, a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:3], pa.array(languages(whole, bounds), pa.int32()), words], names=[*names, "language", "ids"])

    rows = packed.repartition(many, "doc_id").join(known.repartition(many, "doc_id"), "doc_id")
    dealt = rows.withColumns({"fold": fold.cast("int"), "shard": F.spark_partition_id()}).sortWithinPartitions("fold", "doc_id", F.xxhash64("packed"), "packed")
    return stored(dealt.select(*names, "packed").mapInArrow(work, "fold int, shard int, label int, language int, ids binary"), "shards")


def _runs(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, shard, part, ids, bounds, labels, languages) of a shard's rows, in parts of at most ``words`` words, or of one row."""
    key, part, held, size = None, 0, [], 0

    def made():
        ids = np.concatenate([x for x, _, _ in held], 1) + np.arange(3, dtype=np.int32)[:, None] * TABLE
        return *key, part, ids, np.cumsum([0, *(x.shape[1] for x, _, _ in held)]), np.array([y for _, y, _ in held]), np.array([k for _, _, k in held])

    for batch in batches:
        for fold, shard, label, language, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(packed, np.uint16).astype(np.int32).reshape(3, -1)
            if held and (key != (fold, shard) or size + ids.shape[1] > words):
                yield made()
                part = part + 1 if key == (fold, shard) else 0
                held, size = [], 0
            key = fold, shard
            held.append((ids, label, language))
            size += ids.shape[1]
    if held:
        yield made()


def _round(shards: DataFrame, models: list[TextCnn], weights: list[tuple[float, float]], turn: int, words: int) -> None:
    """Each shard passes once over its rows; each parameter row moves by the mean of the changes that shards made."""
    shared = shards.sparkSession.sparkContext.broadcast(models)
    names = [f"c{k}" for k in range(WIDTH + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [m.rows() for m in shared.value]
        change, n = [np.zeros(m.shape, np.int64) for m in before], [np.zeros(len(m), np.int64) for m in before]
        for fold, shard, part, ids, bounds, labels, _ in _runs(batches, words):
            model = shared.value[fold].copy()
            touched = model.epoch(ids, bounds, labels, weights[fold], (7, turn, shard, part))
            row = np.concatenate([np.flatnonzero(touched), 3 * TABLE + np.arange(2 * DENSE_ROWS)])
            change[fold][row] += np.rint((model.rows()[row].astype(np.float64) - before[fold][row]) * UNIT).astype(np.int64)
            n[fold][row] += 1
        for fold in range(len(before)):
            row = np.flatnonzero(n[fold])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), fold, np.int32)), pa.array(row.astype(np.int32)), pa.array(n[fold][row]), *(pa.array(c) for c in change[fold][row].T)], names=["fold", "row", "n", *names])

    # Few tasks, as many as run at once, add up their shards' changes before these are shuffled.
    few = shards.coalesce(max(1, shards.sparkSession.sparkContext.defaultParallelism))
    made = few.mapInArrow(work, ", ".join(["fold int", "row int", *(f"{c} long" for c in ("n", *names))]))
    got = made.groupBy("fold", "row").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toArrow()
    shared.destroy()
    fold, row, n = (got.column(c).to_numpy() for c in ("fold", "row", "n"))
    change = np.stack([got.column(c).to_numpy() for c in names], 1) / (n[:, None] * UNIT)
    for k, model in enumerate(models):
        model.moved(row[fold == k], change[fold == k].astype(np.float32))


def _calibrated(shards: DataFrame, models: list[TextCnn], words: int) -> None:
    """Thresholds of each model by all rows that it was not trained on; of a single model by all rows."""
    shared = shards.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, _, _, ids, bounds, labels, language in _runs(batches, words):
            k = len(shared.value) - 1 - fold
            at = np.rint(np.clip(shared.value[k].logits(ids, bounds), -60, 60) / STEP).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(language.astype(np.int32)), pa.array(labels.astype(np.int32)), pa.array(at)], names=["model", "language", "label", "at"])

    made = shards.mapInArrow(work, "model int, language int, label int, at int")
    got = made.groupBy("model", "language", "label", "at").count().toArrow()
    shared.destroy()
    model, language, label, at, n = (got.column(c).to_numpy() for c in ("model", "language", "label", "at", "count"))
    for k, one in enumerate(models):
        own = model == k
        one.calibrate(at[own] * STEP, language[own], label[own], n[own])


def _sample_ids(rows: DataFrame, words: int):
    """doc_id, label, ids (of the words) and language of a sample, on the driver: rows in hash order, bounded in words for each class.

    For looking at rows; ``fit`` learns from all rows and does not use it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            packed, language = [], []
            for _, _, part, at in tb.pieces(data, offsets):
                ids, bounds, whole = word_ids(part, at)
                language += languages(whole, bounds).tolist()
                packed += [ids[:, a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary()), pa.array(language, pa.int64())], names=["doc_id", "label", "ids", "language"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = stored(rows.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(work, f"doc_id {kind}, label int, ids binary, language long"), "sample")
    # The sizes of a bounded number of rows; the words themselves stay where they are until the bound is known.
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids"))
    size = F.octet_length("ids") / 12
    place = made.select("doc_id", "label", F.xxhash64("ids").alias("key"), F.sum(size).over(first).alias("upto"), F.row_number().over(first).alias("n"))
    few = place.filter((F.col("n") == 1) | (F.col("upto") <= words / 2)).select("doc_id", "label", "key").distinct()
    whole = made.withColumn("key", F.xxhash64("ids")).join(F.broadcast(few), ["doc_id", "label", "key"], "left_semi").drop("key")
    got = whole.toPandas()
    dropped(made)
    got["order"] = [zlib.crc32(x) for x in got["ids"]]
    return got.sort_values(["doc_id", "order"], kind="stable").reset_index(drop=True)


def scored(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id and score, 0 to 1, of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of one size, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            scores = [shared.value.scores(part, at) for _, _, part, at in tb.pieces(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, score double")


def fifth(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels, fifth() != 0))
    return out.select("doc_id", F.coalesce(fifth() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
