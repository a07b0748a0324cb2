"""MinHash near-duplicates: universal hash minima, banding, verification on full sets, connected components.

Texts with one shingle set are one class from the start. Class representatives get ``HASHES``
universal hash minima; ``BANDS`` bands of ``ROWS`` minima are bucket keys. A pair of similarity 0.8
shares no bucket with a probability of 5e-8.

Links inside a bucket are found without making its pairs:

1. Every member is checked against one hub, the bucket's most central member (the one that sits in
   the most and largest buckets), and components are formed.
2. Only buckets that still hold several components go on. Inside tasks that each take a block of
   bounded size, members outside the bucket's largest component meet the members of other
   components: first their signatures (one byte of each minimum; at least ``AGREE`` must agree,
   which a pair of similarity 0.8 fails with a probability of 3e-9), then their sets. Each link
   that is found joins two components inside the block at once, so a block returns fewer links
   than it has components.

Bands and screen together lose a pair of similarity 0.8 with a probability of 5e-8, and then only if
no chain of other links joins it.

Every link is confirmed on the two full shingle sets; blocks carry sets of 32-bit hashes, and if a
confirmation ever fails the blocks are run again with 64 bits. The outcome is each row's component.

Defined cases: a null or empty text, or one without words, has no shingles and no links; one word
is one shingle; a null doc_id gets component_id null and is kept; repeated rows share a component,
and rows of one doc_id with different texts are one node. doc_id may be of any type that has an
order; whole numbers give long results, others are numbered in their order inside. Empty tables give
empty results. Other columns, whatever their names, are carried through by ``deduplicated`` only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastercat.llm import textbytes as tb
from rastercat.llm.components import components
from rastercat.llm.storage import column, dropped, stored, unused

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
AGREE = 74
#: Shingles of a bucket's members that one block holds, about, and rows that are compared with them.
BLOCK, BLOCK_ROWS = 1 << 20, 2048
PERCENT, SHINGLE = 80, 2

_rng = np.random.default_rng(6)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_NOT_SPACE = ~tb.SPACES


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    lowered = tb.LOWER[data]
    starts, ends = tb.word_spans(lowered, offsets, _NOT_SPACE)
    bounds = tb.counts_in(offsets, starts)
    hashes = tb.span_hashes(tb.prefix_sums(lowered), starts, ends)
    windows = tb.sequence_hashes(hashes, words) if len(hashes) >= words else hashes[:0]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= words:
            yield np.unique(windows[lo : hi - words + 1])
        else:
            yield tb.sequence_hashes(hashes[lo:hi], hi - lo) + np.uint64(hi - lo) if hi > lo else hashes[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The signature: the least value of each universal hash, 32 bits each."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def bucket_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    values = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = tb.mixed(key + values[:, r])
    return key.view(np.int64)


def features(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (the set's fingerprint), keys (of its buckets), signature (a byte of each minimum)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            sizes, one, two, keys, signatures = [], [], [], [], []
            for _, _, part, at in tb.pieces(data, offsets):
                for own in shingle_sets(part, at, words):
                    sizes.append(len(own))
                    one.append(int(tb.mixed(own).sum().view(np.int64)))
                    two.append(int(tb.mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)))
                    least = minima(own)
                    keys.append(bucket_keys(least) if len(own) else None)
                    signatures.append((least & np.uint32(255)).astype(np.uint8).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "f1", "f2", "keys", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, signature binary")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union; texts(id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = (shingle_sets(*tb.buffers(batch.column(k)), words) for k in (2, 3))
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches cut into tables at ends of runs of equal (key, row, column)."""
    rest: list[pa.RecordBatch] = []

    def cuts(batch: pa.RecordBatch) -> np.ndarray:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
        return np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = tuple(batch.column(k)[0].as_py() for k in range(3))
        if rest and first != last:
            yield pa.Table.from_batches(rest)
            rest = []
        at = cuts(batch)
        if len(at):
            rest.append(batch.slice(0, int(at[-1])))
            yield pa.Table.from_batches(rest)
            rest = [batch.slice(int(at[-1]))]
        else:
            rest.append(batch)
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(3))
    if rest:
        yield pa.Table.from_batches(rest)


def packed_sets(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """(id, n, packed): each text's shingle set as hashes of 32 or 64 bits."""
    kind = np.uint32 if bits == 32 else np.uint64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            sets = [own for _, _, part, at in tb.pieces(data, offsets) for own in shingle_sets(part, at, words)]
            packed = pa.array([(own >> np.uint64(64 - bits)).astype(kind).tobytes() for own in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), packed], names=["id", "n", "packed"])

    return texts.select("id", "text").mapInArrow(work, "id long, n long, packed binary")


def _block_links(ids, comps, sizes, as_row, signatures, sets, agree: int, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) of a block that join components: a forest, found in the order of the rows."""
    rows, columns = np.flatnonzero(as_row), np.flatnonzero(~as_row)
    _, root = np.unique(comps, return_inverse=True)
    if len(rows) == 0 or len(columns) == 0:
        return []
    columns_signatures = signatures[columns]
    known, codes, starts, links = None, None, None, []
    for i in rows.tolist():
        apart = root[columns] != root[i]
        if not apart.any():
            continue
        near = np.flatnonzero(apart)
        near = near[(columns_signatures[near] == signatures[i]).sum(1) >= agree]
        if not len(near):
            continue
        if known is None:
            known, codes = np.unique(np.concatenate([sets[c] for c in columns.tolist()]), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum([len(sets[c]) for c in columns.tolist()])])
            marked = np.zeros(len(known), np.int32)
        at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
        at = at[known[at] == sets[i]]
        marked[at] = 1
        both = np.array([marked[codes[starts[c] : starts[c + 1]]].sum() for c in near.tolist()]) if len(near) < len(columns) // 4 else np.add.reduceat(marked[codes], starts[:-1])[near]
        marked[at] = 0
        hit = near[100 * both >= percent * (sizes[i] + sizes[columns[near]] - both)]
        for c in columns[hit].tolist():
            if root[c] != root[i]:
                links.append((int(ids[i]), int(ids[c])))
                root[root == root[c]] = root[i]
    return links


def _linking(blocks: DataFrame, agree: int, percent: int, bits: int) -> DataFrame:
    """(a, b): the links that the blocks find; blocks are dealt and sorted by (key, row, column)."""
    kind = np.uint32 if bits == 32 else np.uint64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            key, row, column, ids, comps, sizes, as_row = (table.column(k).to_numpy() for k in range(7))
            signatures = tb.buffers(table.column(7))[0].reshape(-1, HASHES)
            packed, at = tb.buffers(table.column(8))
            sets = [packed[a:b].copy().view(kind) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (row[1:] != row[:-1]) | (column[1:] != column[:-1])) + 1
            links: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                links += _block_links(ids[lo:hi], comps[lo:hi], sizes[lo:hi], as_row[lo:hi], signatures[lo:hi], sets[lo:hi], agree, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(work, "a long, b long")


def _with_components(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links(a, b): links are between components, and the components that they join get one name."""
    name = comps.withColumnRenamed("component", "c")
    ends = links.join(name.withColumnRenamed("id", "a").withColumnRenamed("c", "ca"), "a", "left").join(name.withColumnRenamed("id", "b").withColumnRenamed("c", "cb"), "b", "left")
    between = stored(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "links")
    more = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = more.select(F.col("id").alias("old"), F.col("component").alias("new"))
    nodes = comps.union(between.select("a", "ca")).union(between.select("b", "cb")).distinct()
    out = stored(nodes.join(joined, nodes["component"] == joined["old"], "left").select("id", F.coalesce("new", "component").alias("component")), "components")
    dropped(between, more, comps)
    return out


def link_components(reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int = SHINGLE, percent: int = PERCENT, agree: int = AGREE, block: int = BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, component) of all representatives (id, keys, signature) that have a link; ``texts_of`` gives (id, text) of given ids."""
    keys = stored(reps.select(F.explode("keys").alias("key"), "id"), "bucket-keys")
    # What is counted by key is stored before it is joined, so that a hot bucket's rows can be split over tasks.
    buckets = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    sized = stored(keys.join(buckets, "key").select("key", "id", "n"), "members")
    central = sized.groupBy("id").agg(F.sum("n").alias("central"))
    texts = stored(texts_of(central.select("id")), "candidate-texts")
    members = stored(sized.join(central, "id").select("key", "id", "central"), "members")
    dropped(keys, buckets, sized)

    # 1. One hub for each member: of its buckets' most central members the one that it meets most often.
    hub = F.struct("central", (-F.col("id")).alias("less"))
    hubs = stored(members.groupBy("key").agg((-F.max(hub)["less"]).alias("hub")), "hubs")
    met = members.join(hubs, "key").filter("hub <> id").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = met.groupBy("id").agg(F.max(F.struct("n", (-F.col("hub")).alias("less"))).alias("best"))
    pairs = best.select(F.col("id").alias("a"), (-F.col("best.less")).alias("b"))
    links = confirmed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, words, percent)
    links = stored(links, "links")
    comps = components(links)
    dropped(links, hubs)

    # 2. What is left: buckets with several components, by blocks.
    for bits in (32, 64):
        blocks, parts = _blocks(members, comps, reps, packed_sets(texts, words, bits), block, block_rows)
        found = stored(_linking(blocks, agree, percent, bits).distinct(), "found")
        links = stored(confirmed(found, texts, words, percent).distinct(), "links")
        whole = links.count() == found.count()
        comps = _merged(comps, links)
        dropped(found, links, *parts)
        if bits == 64 or whole:
            dropped(members, texts)
            return comps


def _blocks(members: DataFrame, comps: DataFrame, reps: DataFrame, sets: DataFrame, block: int, block_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """Buckets with several components: members outside the largest as rows, all as columns, dealt to a grid of blocks; and what was stored for it."""
    named = _with_components(members.select("key", "id"), comps)
    shares = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    split = shares.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("many"), F.max(F.struct("n", "component"))["component"].alias("main"), F.max("n").alias("most")).filter("parts > 1")
    split = stored(split, "split-buckets")
    sizes = sets.select("id", "n")
    kept = stored(named.join(split, "key").join(sizes, "id"), "left")
    columns = stored(kept.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block)).alias("columns")), "columns")
    left = kept.join(columns, "key").withColumn("rows", F.greatest(F.lit(1), F.ceil((F.col("many") - F.col("most")) / block_rows)))
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    as_rows = left.filter("component <> main").select("key", slot("rows").cast("long").alias("row"), every("columns").alias("column"), "id", "component", F.lit(True).alias("as_row"))
    as_columns = left.select("key", every("rows").alias("row"), slot("columns").cast("long").alias("column"), "id", "component", F.lit(False).alias("as_row"))
    payload = sets.join(reps.select("id", "signature").dropDuplicates(["id"]), "id")
    blocks = as_rows.union(as_columns).join(payload, "id").select("key", "row", "column", "id", "component", "n", "as_row", "signature", "packed")
    return blocks.repartition("key", "row", "column").sortWithinPartitions("key", "row", "column"), [split, kept, columns]


def near_duplicates(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _numbered(docs, words, percent, **options)
    rows = stored(features(docs, words), "features")
    classes = stored(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    reps = rows.join(classes.withColumnRenamed("id", "doc_id"), ["f1", "f2", "n_shingles", "doc_id"]).select(F.col("doc_id").alias("id"), "keys", "signature")

    def texts_of(ids: DataFrame) -> DataFrame:
        return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")

    reps = stored(reps, "representatives")
    linked = link_components(reps, texts_of, words, percent, **options)
    dropped(reps)
    named = classes.join(linked, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component"))
    # A doc_id with several texts is one node: its classes get one component.
    shared = rows.filter("n_shingles > 0 and doc_id is not null").select("doc_id", "f1", "f2", "n_shingles").distinct()
    several = stored(shared.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shared-ids")
    if not several.isEmpty():
        ends = shared.join(several, "doc_id").join(named, ["f1", "f2", "n_shingles"]).groupBy("doc_id", "component").count()
        extra = components(ends.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))).select(F.col("id").alias("old"), F.col("component").alias("new"))
        named = named.join(extra, named["component"] == extra["old"], "left").select("f1", "f2", "n_shingles", F.coalesce("new", "component").alias("component"))
    out = rows.join(named, ["f1", "f2", "n_shingles"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def _numbered(docs: DataFrame, words: int, percent: int, **options) -> DataFrame:
    """near_duplicates by numbers that have the order of the ids."""
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").alias("name")).distinct().orderBy("name")
    names = stored(ids.select("name", F.monotonically_increasing_id().alias("number")), "names")
    found = near_duplicates(docs.select(F.col("doc_id").alias("name"), "text").join(names, "name", "left").select(F.col("number").alias("doc_id"), "text"), words, percent, **options)
    name = lambda n: names.select(F.col("number").alias(n), F.col("name").alias(f"{n}_name"))
    named = found.join(name("doc_id"), "doc_id", "left").join(name("component_id"), "component_id", "left")
    return named.select(F.col("doc_id_name").alias("doc_id"), "n_shingles", F.col("component_id_name").alias("component_id"), "kept")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the least of their component; repeated rows of one doc_id stay together."""
    (name,) = unused(docs, "gone")
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    gone = near_duplicates(docs.select("doc_id", "text"), **options).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    doc_id = F.col("d.doc_id").cast("long") if whole else F.col("d.doc_id")
    return docs.alias("d").join(gone, doc_id == F.col(column(name)), "left_anti")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM o UNION SELECT b, a FROM o
), r(id, c) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.c AS component_id, doc_id = c.c AS kept
FROM s JOIN c ON c.id = s.doc_id
"""
