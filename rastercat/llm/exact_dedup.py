"""Exact duplicates: static binary-fuse filters screen incoming digests, positives meet in exact buckets.

A corpus is an immutable snapshot and an incoming batch. The snapshot's digests become binary-fuse
filters, one for each shard of the digest space. Duplicates inside the batch are grouped first, by
themselves; one digest of each group is screened by the filter of its shard. What the filter lets
through, and every digest with several rows, goes to the exact bucket of its digest, where whole
texts are compared. So a filter's false positive costs one comparison and changes nothing.

``build_snapshot`` keeps filters and buckets with a snapshot, and ``screen_batch`` reads them for each batch that comes.

Defined cases: a null text counts as empty and all empty texts are equal; a null doc_id is an id
that sorts last; rows with equal doc_id and text are all ``kept`` by ``duplicate_groups`` if they
are the row that stays (they can't be told apart), and ``deduplicated`` returns one of them. Empty
tables give empty results. Other columns, whatever their names, are carried through by
``deduplicated`` only. doc_id may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastercat.llm.storage import column, stored, unused

#: Digests in one filter: about 300 KB of fingerprints.
SHARD = 1 << 18
#: Bucket digests (32 bytes each) that are broadcast for the byte checks; more of them are joined by a shuffle.
BROADCAST = 1 << 18
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


# --- binary-fuse filters -------------------------------------------------------------------------


class BinaryFuse:
    """A static set of 64-bit keys with 8-bit fingerprints in three neighbouring segments."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift in (33, 29, 32):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
        first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64), ((h ^ (h >> np.uint64(41))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
        for seed in range(1, 200):
            room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) * (1 + seed // 20 * 0.1)
            segments = max(1, math.ceil(room / segment) - 2)
            slots, prints = cls._slots(keys, seed, segment, segments)
            if (order := cls._peeled(slots, (segments + 2) * segment)) is not None:
                out = np.zeros((segments + 2) * segment, np.uint8)
                for keys_at, slot_at in reversed(order):  # those of one round don't touch each other's free slot
                    out[slot_at] = 0
                    a, b, c = slots[:, keys_at]
                    out[slot_at] = prints[keys_at] ^ out[a] ^ out[b] ^ out[c]
                return cls(seed, segment, segments, out)
        raise ValueError("no binary-fuse filter was found")

    @staticmethod
    def _peeled(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, their free slots), or None if keys are left that share all their slots."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        ids = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(ids, row, np.arange(n))
        order, left, free = [], n, np.flatnonzero(count == 1)
        while left:
            free = free[count[free] == 1]
            if not len(free):
                return None
            keys_at, first = np.unique(ids[free], return_index=True)
            order.append((keys_at, free[first]))
            left -= len(keys_at)
            touched = slots[:, keys_at]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(ids, row, keys_at)
            free = np.unique(touched)
        return order

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return prints == self.prints[a] ^ self.prints[b] ^ self.prints[c]


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, segment, segments, prints): one filter for each shard of the 64-bit ``key`` column."""

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(rows["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [shard[0]], "seed": [made.seed], "segment": [made.segment], "segments": [made.segments], "prints": [made.prints.tobytes()]})

    sharded = keys.select("key", _shard(shards))
    return sharded.groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, segments int, prints binary")


def screened(keys: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The keys that the filter of their shard lets through."""

    def screen(rows: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if not len(made) or not len(rows):
            return pd.DataFrame({"key": pd.Series([], dtype="int64")})
        x = made.iloc[0]
        fuse = BinaryFuse(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["prints"], np.uint8))
        return rows.loc[fuse.has(rows["key"].to_numpy().view(np.uint64)), ["key"]]

    sharded = keys.select("key", _shard(shards))
    return sharded.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(screen, "key long")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col("key")), F.lit(shards)).cast("int").alias("shard")


# --- groups --------------------------------------------------------------------------------------


def _best() -> Column:
    return F.min(F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "n_same"))


def duplicate_groups(docs: DataFrame, in_snapshot: Column | None = None, digest: Callable[[Column], Column] = sha256, shard: int = SHARD) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, keep_id, group_size, kept, digest, n_same.

    Of equal normalised texts the row with the most code points stays, then the smallest doc_id.
    ``in_snapshot`` tells the snapshot's rows from the incoming batch; by default half of all ids.
    """
    in_snapshot = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    text = normalised(F.col("text"))
    rows = stored(docs.select("doc_id", in_snapshot.alias("old"), digest(text).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_points")), "digests")
    same = rows.groupBy("old", "digest", "doc_id").agg(F.count("*").alias("n_same"), F.max("n_points").alias("n_points"))
    groups = stored(same.groupBy("old", "digest").agg(F.sum("n_same").alias("n"), _best().alias("best")).withColumn("key", F.xxhash64("digest")), "digest-groups")

    sizes = groups.groupBy("old").count().collect()  # two numbers
    shards = max(1, math.ceil(max((r["count"] for r in sizes), default=0) / shard))
    old, new = groups.filter("old"), groups.filter("not old")
    hits = screened(new, build_filters(old, shards), shards)

    # A bucket for each digest that has, or may have, several rows; both sides' digests are single rows here.
    several = groups.filter("n > 1").select("key").union(hits).distinct()
    buckets = groups.join(several, "key", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"), F.min("best").alias("best"))
    buckets = stored(buckets.filter("n > 1"), "buckets")

    # Byte checks: the buckets' whole texts are grouped by themselves; equal ones are combined before they move.
    texts = docs.select("doc_id", text.alias("norm"), digest(text).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"))
    if buckets.count() <= BROADCAST:
        distinct = texts.join(F.broadcast(buckets.select("digest")), "digest", "left_semi").select("digest", "norm").distinct()
    else:
        distinct = texts.select("digest", "norm").distinct().join(buckets.select("digest"), "digest", "left_semi")
    clashes = stored(distinct.groupBy("digest").count().filter("count > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        return _named(rows.join(buckets, "digest", "left"))
    # Different texts with one digest: their groups are keyed by the text.
    clashing = texts.join(clashes, "digest", "left_semi")
    same = clashing.groupBy("digest", "norm", "doc_id").agg(F.count("*").alias("n_same"), F.max("n_points").alias("n_points"))
    by_text = same.groupBy("digest", "norm").agg(F.sum("n_same").alias("n"), _best().alias("best"))
    apart = clashing.join(by_text, ["digest", "norm"], "left").drop("norm")
    plain = rows.join(clashes, "digest", "left_anti").join(buckets, "digest", "left")
    return _named(plain.select("doc_id", "digest", "n_points", "n", "best").union(apart.select("doc_id", "digest", "n_points", "n", "best")))


def _named(rows: DataFrame) -> DataFrame:
    alone = F.col("best").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "digest",
        F.coalesce("best.n_same", F.lit(1)).alias("n_same"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    (tag,) = unused(docs, "digest")
    digest = options.get("digest", sha256)
    groups = stored(duplicate_groups(docs.select("doc_id", "text"), **options), "duplicates")
    tagged = docs.withColumn(tag, digest(normalised(F.col("text")))).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{column(tag)}") == F.col("g.digest"))
    repeated = groups.filter("kept and n_same > 1").select("doc_id", "digest").distinct()
    gone = groups.filter("not kept").select("doc_id", "digest").distinct().union(repeated)
    left = tagged.join(gone.alias("g"), same, "left_anti")
    if not repeated.isEmpty():
        left = left.union(tagged.join(repeated.alias("g"), same, "left_semi").dropDuplicates(["doc_id", tag]))
    return left.select(*(column(c) for c in docs.columns))


# --- snapshots that stay -----------------------------------------------------------------------------

#: Buckets of a snapshot that is written.
BUCKETS = 256


def _distinct(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, norm, n and best of each distinct normalised text."""
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.alias("norm"), digest(text).alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"))
    same = rows.groupBy("digest", "norm", "doc_id").agg(F.count("*").alias("n_same"), F.max("n_points").alias("n_points"))
    return same.groupBy("digest", "norm").agg(F.sum("n_same").alias("n"), _best().alias("best"))


def build_snapshot(docs: DataFrame, path: str, digest: Callable[[Column], Column] = sha256, buckets: int = BUCKETS, shard: int = SHARD) -> None:
    """Write docs(doc_id, text) as an immutable snapshot below path, which must not exist: its filters, and its distinct texts in exact buckets by digest."""
    rows = _distinct(docs, digest).withColumn("key", F.xxhash64("digest"))
    placed = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")).select("key", "digest", "norm", F.col("best.doc_id").alias("doc_id"), "bucket")
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/buckets")
    keys = docs.sparkSession.read.schema(placed.schema).parquet(f"{path}/buckets").select("key")
    shards = max(1, math.ceil(keys.count() / shard))
    build_filters(keys, shards).withColumns({"shards": F.lit(shards), "buckets": F.lit(buckets)}).write.parquet(f"{path}/filters")


def screen_batch(batch: DataFrame, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of batch(doc_id, text) against the snapshot at path: doc_id, keep_id, group_size, kept, in_snapshot.

    A text of the snapshot is not kept, and keep_id is the snapshot's row; of equal new texts the best one stays.
    group_size counts the batch's rows. The batch reads the snapshot's filters; of its buckets only those of
    digests that a filter lets through are opened, and there texts are compared byte by byte.
    """
    spark = batch.sparkSession
    filters = spark.read.parquet(f"{path}/filters")
    groups = stored(_distinct(batch, digest).withColumn("key", F.xxhash64("digest")), "batch-groups")
    hits = groups.limit(0).select("key")
    there = filters.select("shards", "buckets").first()  # none of a snapshot without rows
    if there:
        hits = stored(screened(groups.select("key").distinct(), filters.drop("shards", "buckets"), there["shards"]), "batch-hits")
    wanted = [r[0] for r in hits.select(F.pmod("key", F.lit(there["buckets"])).cast("int")).distinct().collect()] if there else []  # as many as there are buckets
    known = spark.createDataFrame([], f"digest binary, norm string, doc_id {batch.schema['doc_id'].dataType.simpleString()}")
    if wanted:
        rows = spark.read.parquet(f"{path}/buckets").filter(F.col("bucket").isin(*wanted))
        known = rows.join(hits, "key", "left_semi").select("digest", "norm", "doc_id")
    known = known.select("digest", "norm", F.col("doc_id").alias("old_id"), F.lit(True).alias("old"))
    named = groups.join(known, ["digest", "norm"], "left").select("digest", "norm", "n", "best", "old_id", F.coalesce("old", F.lit(False)).alias("old"))
    text = normalised(F.col("text"))
    rows = batch.select("doc_id", text.alias("norm"), digest(text).alias("digest")).join(named, ["digest", "norm"])
    keep = F.when(F.col("old"), F.col("old_id")).otherwise(F.col("best.doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"), (~F.col("old") & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("kept"), F.col("old").alias("in_snapshot"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays for it."""
    groups = duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""
