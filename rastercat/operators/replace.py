"""Replacement plans, their application to contents, and hash reuse between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.functions import hashing
from rastercat.operators import similarity


def id_replace_plan(hashed: DataFrame, small: int = 256, large: int = 256, hash_size: int = 8, threshold: int = 6, near_only: bool = False) -> DataFrame:
    """Every small image with its best large one of its ID group: dst_path, src_path, hamming, replaced, reason.

    ``near_only`` leaves out those that are not replaced, and then never pairs all hashes of a group.
    """
    hashing.check_threshold(threshold, hash_size)
    if near_only:
        best = similarity.best_large_near(hashed, small, large, hash_size, threshold)
    else:
        best = similarity.best_large_of_distinct(hashed, small, large, hash_size)
    return best.select(
        F.col("small_path").alias("dst_path"), F.col("large_path").alias("src_path"), "hamming", (F.col("hamming") <= threshold).alias("replaced"), F.lit("id_replace").alias("reason")
    )


def replacement_summary(plan: DataFrame) -> DataFrame:
    """One row: replaced and skipped."""
    return plan.agg(F.count_if("replaced").alias("replaced"), F.count_if(~F.col("replaced")).alias("skipped"))


def apply_replacements(contents: DataFrame, plan: DataFrame, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """contents(rel_path, mtime, columns) with planned rows' columns taken from their source; times stay.

    Sources are read as they were before the step. A destination has one planned source; a source that
    is missing leaves its destination as it is.
    """
    planned = plan.filter("replaced") if "replaced" in plan.columns else plan
    sources = contents.select(F.col("rel_path").alias("src_path"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__found"))
    moved = planned.select("dst_path", "src_path").join(sources, "src_path").drop("src_path")
    joined = contents.join(moved, contents["rel_path"] == moved["dst_path"], "left")
    taken = {c: F.when(F.col("__found"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(taken).select(*contents.columns)


def composed_sources(first: DataFrame, then: DataFrame) -> DataFrame:
    """One plan for two steps: what ``then`` copies comes from where ``first`` took it, so bytes move once."""
    origin = first.select(F.col("dst_path").alias("src_path"), F.col("src_path").alias("__origin"))
    later = then.select("dst_path", "src_path", "reason").join(origin, "src_path", "left").select("dst_path", F.coalesce("__origin", "src_path").alias("src_path"), "reason")
    earlier = first.select("dst_path", "src_path", "reason").join(later.select("dst_path"), "dst_path", "left_anti")
    return earlier.unionByName(later)


def split_hashes(catalog: DataFrame, manifest: DataFrame, hash_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits with hash_words, misses) of catalog(rel_path, mtime_ns, size, more) against manifest(rel_path, mtime_ns, size, hash, hash_size)."""
    known = manifest.select("rel_path", F.col("mtime_ns").alias("__m"), F.col("size").alias("__s"), F.col("hash_size").alias("__n"), hashing.hash_from_hex(F.col("hash"), hash_size).alias("hash_words"))
    joined = catalog.join(known, "rel_path", "left")
    hit = F.coalesce((F.col("__n") == hash_size) & (F.col("__m") == F.col("mtime_ns")) & (F.col("__s") == F.col("size")) & F.col("hash_words").isNotNull(), F.lit(False))
    tagged = joined.withColumn("__hit", hit).drop("__m", "__s", "__n")
    return tagged.filter("__hit").drop("__hit"), tagged.filter("not __hit").drop("__hit", "hash_words")


def reuse_hashes(catalog: DataFrame, manifest: DataFrame, recomputed: DataFrame, hash_size: int = 8) -> DataFrame:
    """catalog with hash_words: the manifest's where it is valid, else those of recomputed(rel_path, hash_words)."""
    hits, misses = split_hashes(catalog, manifest, hash_size)
    again = misses.join(recomputed.select("rel_path", "hash_words"), "rel_path")
    return hits.withColumn("reused", F.lit(True)).unionByName(again.withColumn("reused", F.lit(False)))


def carried_forward(old: DataFrame, new: DataFrame, current: DataFrame) -> DataFrame:
    """Manifest rows for the next run: new ones, and old ones that are still current and not made anew."""
    retained = old.join(current.select("rel_path"), "rel_path", "left_semi").join(new.select("rel_path"), "rel_path", "left_anti")
    return retained.unionByName(new)
