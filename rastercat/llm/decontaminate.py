"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over training token windows.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window
is ``n`` consecutive words of a test item; an item of fewer words is one window. The set of window
hashes is broadcast slice by slice, each of about ``SLICE_BYTES``, so a benchmark of any size is used
whole: one slice at a time is on the driver, and its hits are stored before the next is fetched. A
longer item is cut into pieces that overlap by n - 1 words. Hits on hashes are verified word by word;
what is removed is whole words inside verified windows of any slice, all found in the input text, or
the whole document.

Defined cases: null and empty texts have no words and are never contaminated; an item with no words
has no window; rows of one item_id are one item; a null item_id counts as the string 'null'. An empty
benchmark leaves every document clean. Only doc_id, text and item_id are used; ``cleaned`` carries all
other columns, whatever their names. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.llm import textbytes as tb
from rastercat.llm.storage import column, dropped, kinds, mapped, stored, unused

WINDOW = 10
#: Text bytes of the benchmark in one broadcast, about; beyond, documents are scanned once for each slice.
SLICE_BYTES = 16 << 20

WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


class Windows:
    """The windows of some test items, by word count and hash."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = WINDOW):
        self.by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            words = tb.words_of_bytes(tb.LOWER[np.frombuffer(text, np.uint8)].tobytes(), WORD)
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.index = {size: self._indexed(windows) for size, windows in self.by_length.items()}

    @staticmethod
    def _indexed(windows: dict) -> tuple[np.ndarray, np.ndarray]:
        size = len(next(iter(windows)))
        text = b" ".join(b" ".join(w) for w in windows)
        data = np.frombuffer(text, np.uint8)
        starts, ends = tb.word_spans(data, np.array([0, len(data)]), WORD)
        hashes = np.unique(tb.sequence_hashes(tb.span_hashes(tb.prefix_sums(data), starts, ends), size)[::size])
        seen = np.zeros(1 << 20, bool)
        seen[hashes & np.uint64(len(seen) - 1)] = True
        return hashes, seen

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, set[str], np.ndarray]]:
        """(document, words, starts, ends, items, hit words) of each document; ``data`` is lower-cased."""
        starts, ends = tb.word_spans(data, offsets, WORD)
        bounds = tb.counts_in(offsets, starts)
        hashes = tb.span_hashes(tb.prefix_sums(data), starts, ends)
        found: dict[int, list[tuple[int, int, set[str]]]] = {}
        for size, (known, seen) in self.index.items():
            if len(hashes) < size:
                continue
            windows = tb.sequence_hashes(hashes, size)
            at = np.flatnonzero(seen[windows & np.uint64(len(seen) - 1)])
            at = at[known[np.minimum(np.searchsorted(known, windows[at]), len(known) - 1)] == windows[at]]
            owner = np.searchsorted(bounds, at, "right") - 1
            at, owner = at[at + size <= bounds[owner + 1]], owner[at + size <= bounds[owner + 1]]
            for w, doc in zip(at.tolist(), owner.tolist(), strict=True):
                words = tuple(data[a:b].tobytes() for a, b in zip(starts[w : w + size].tolist(), ends[w : w + size].tolist(), strict=True))
                if items := self.by_length[size].get(words):
                    found.setdefault(doc, []).append((w, w + size, items))
        for doc in range(len(offsets) - 1):
            lo, hi = int(bounds[doc]), int(bounds[doc + 1])
            hit, items = np.zeros(0, bool), set()
            if doc in found:
                hit = np.zeros(hi - lo, bool)
                for a, b, named in found[doc]:
                    hit[a - lo : b - lo] = True
                    items |= named
            yield doc, hi - lo, starts[lo:hi], ends[lo:hi], items, hit


def _pieces(benchmark: DataFrame, n: int, limit: int) -> DataFrame:
    """(item, text) of the benchmark; texts of more than ``limit`` bytes in pieces that together have all their windows."""

    def cut(text: bytes) -> Iterator[bytes]:
        if len(text) <= limit:
            yield text
            return
        data = tb.LOWER[np.frombuffer(text, np.uint8)]
        starts, ends = tb.word_spans(data, np.array([0, len(data)]), WORD)
        first = 0
        while first < len(starts):
            last = max(int(np.searchsorted(ends, starts[first] + limit, "right")), first + n)
            last = min(last, len(starts))
            yield text[starts[first] : ends[last - 1]]
            first = last - n + 1 if last < len(starts) else last

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in cut(text):
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([piece], pa.binary())], names=["item", "text"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(work, "item string, text binary").distinct()


def _slices(benchmark: DataFrame, n: int, limit: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """How many slices the benchmark has, one at least, and the slices, each fetched when it is asked for."""
    pieces = stored(_pieces(benchmark, n, limit), "benchmark")
    many = max(1, -(-(pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit))
    slot = F.pmod(F.xxhash64("item", "text"), F.lit(many))

    def fetched() -> Iterator[list[tuple[str, bytes]]]:
        for k in range(many):
            yield [(r["item"], bytes(r["text"])) for r in pieces.filter(slot == k).collect()]  # about ``limit`` bytes
        dropped(pieces)

    return many, fetched()


def _scanned(docs: DataFrame, items: list[tuple[str, bytes]], n: int, names: list[str]) -> DataFrame:
    """docs with, by the names given, the number of words, of hit words, items (sorted strings) and spans (byte starts and ends of runs of hit words)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    at, columns = docs.columns.index("text"), [*docs.columns, *names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, n)
        for batch in batches:
            data, offsets = tb.buffers(batch.column(at))
            n_words, n_hit, items_of, spans_of = [], [], [], []
            for _, _, part, part_offsets in tb.pieces(data, offsets):
                part = tb.LOWER[part]
                for doc, count, starts, ends, found, hit in windows.hits(part, part_offsets):
                    n_words.append(count)
                    n_hit.append(int(hit.sum()))
                    items_of.append(sorted(found))
                    spans_of.append([x - int(part_offsets[doc]) for x in _runs(starts, ends, hit)] if found else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items_of, pa.list_(pa.string())), pa.array(spans_of, pa.list_(pa.int64()))], names=columns)

    return mapped(docs, scan, columns, [*kinds(docs), "long", "long", "array<string>", "array<long>"])


def _runs(starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> list[int]:
    """Byte starts and ends of the runs of hit words."""
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return np.stack([starts[edges[::2]], ends[edges[1::2] - 1]], 1).ravel().tolist()


def _tags(df: DataFrame, names: list[str]) -> DataFrame:
    """df with two hashes of its texts: what is found in a text depends on nothing else."""
    return df.withColumns({names[0]: F.xxhash64("text"), names[1]: F.xxhash64(F.lit(7), F.col("text"))})


def _of_slices(docs: DataFrame, slices: Iterator[list[tuple[str, bytes]]], n: int) -> DataFrame:
    """(t1, t2, items, spans), stored: what several slices found, for texts in which something was found."""
    texts, parts = _tags(docs.select("text"), ["t1", "t2"]), []
    for some in filter(None, slices):
        found = _scanned(texts, some, n, ["n_words", "n_hit", "items", "spans"])
        parts.append(stored(found.filter("n_hit > 0").select("t1", "t2", "items", "spans"), "hits"))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))) if c == "items" else F.flatten(F.collect_set(c))
    out = stored(reduce(DataFrame.union, parts).groupBy("t1", "t2").agg(flat("items").alias("items"), flat("spans").alias("spans")), "hits")
    dropped(*parts)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings), spans of every document."""
    narrow = docs.select("doc_id", "text")
    many, slices = _slices(benchmark, n, slice_bytes)
    if many == 1:
        return _scanned(narrow, next(slices), n, ["n_words", "n_hit", "items", "spans"]).drop("text")
    found = _of_slices(narrow, slices, n)
    rows = _tags(narrow, ["t1", "t2"]).join(found, ["t1", "t2"], "left").select("doc_id", "text", F.coalesce("items", F.array()).alias("items"), F.coalesce("spans", F.array()).alias("spans"))
    return _recounted(rows)


def _merged(text: bytes | None, spans: list[int]) -> tuple[int, int, list[int]]:
    """(words, words inside the spans, the spans of runs of such words) of a text."""
    data = tb.LOWER[np.frombuffer(text or b"", np.uint8)]
    starts, ends = tb.word_spans(data, np.array([0, len(data)]), WORD)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, np.searchsorted(starts, spans[::2]), 1)
    np.subtract.at(depth, np.searchsorted(ends, spans[1::2], "right"), 1)
    hit = np.cumsum(depth)[:-1] > 0
    return len(starts), int(hit.sum()), _runs(starts, ends, hit)


def _recounted(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, items, spans) of several slices: spans merged, words and hit words counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            got = [_merged(texts[i].as_py(), spans) for i, spans in enumerate(batch.column(3).to_pylist())]
            new = [pa.array([x[k] for x in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), new[0], new[1], batch.column(2), new[2]], names=["doc_id", "n_words", "n_hit", "items", "spans"])

    return mapped(rows, count, ["doc_id", "n_words", "n_hit", "items", "spans"], [*kinds(rows)[:1], "long", "long", "array<string>", "array<long>"])


def cleaned(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without contaminated documents, or (remove='spans') with the hit words cut out of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    columns = [F.col(column(c)) for c in docs.columns]
    many, slices = _slices(benchmark, n, slice_bytes)
    if many == 1:
        names = unused(docs, "n_words", "n_hit", "items", "spans")
        out = _scanned(docs, next(slices), n, names)
        return out.filter(F.col(names[1]) == 0).select(*columns) if remove == "documents" else _cut(out, names[3]).select(*columns)
    names = unused(docs, "t1", "t2", "items", "spans")
    found = _of_slices(docs, slices, n).toDF(*names)
    tagged = _tags(docs, names[:2])
    if remove == "documents":
        return tagged.join(found, names[:2], "left_anti").select(*columns)
    return _cut(tagged.join(found.drop(names[2]), names[:2], "left"), names[3]).select(*columns)


def _cut(rows: DataFrame, spans: str) -> DataFrame:
    """rows with the words inside the byte ranges cut out of text; ranges may overlap, a null one is none."""
    at, by = rows.columns.index("text"), rows.columns.index(spans)

    def without(text: bytes, ranges: list[int]) -> bytes:
        edges = [0, *_merged(text, ranges)[2], len(text)]
        return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(at), batch.column(by).to_pylist()
            if any(ranges):
                raw = texts.cast(pa.binary()).to_pylist()
                texts = pa.array([without(x, r) if r else x for x, r in zip(raw, ranges, strict=True)], pa.binary()).cast(texts.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], names=batch.schema.names)

    return mapped(rows, work, rows.columns, kinds(rows))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with its words that occur in windows of the benchmark."""
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Words by position; a hit is a word covered by an occurrence of a window. Windows are compared as joined words.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, w, len(w) AS n_words, unnest(range(1, len(w) + 1)) AS i FROM d
), hit AS (
  SELECT DISTINCT dw.doc_id, dw.i, bw.n, bw.item_id
  FROM (SELECT dw.doc_id, dw.i, s.n, array_to_string(dw.w[dw.i:dw.i + s.n - 1], ' ') AS win
        FROM dw, (SELECT DISTINCT n FROM bw) s WHERE dw.i + s.n - 1 <= dw.n_words) dw
  JOIN bw ON bw.n = dw.n AND bw.win = dw.win
), per_word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""
