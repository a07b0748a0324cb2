"""Variant consolidation: small images take the content of their best large variant."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat.functions import hashing, imaging, paths
from rastercat.functions.decoders import Decoder
from rastercat.operators import replace, similarity
from rastercat.sources import catalog, listing
from rastercat.sources.scratch import stored


def candidates(images: DataFrame) -> DataFrame:
    """Image rows that may take part: no mips, at least two dashes; with id_key."""
    rows = images.filter(paths.is_image(F.col("ext")) & ~paths.is_mip(F.col("stem")) & paths.is_eligible(F.col("stem")))
    return rows.withColumn("id_key", paths.id_key(F.col("stem")))


@dataclass
class Consolidation:
    """plan: as ``replace.id_replace_plan``; hashed: the rows that it is made from, with ``reused``; manifest: what the next run reads; failed: (rel_path, message), of folders."""

    plan: DataFrame
    hashed: DataFrame
    manifest: DataFrame
    failed: DataFrame | None = None


def hashed_variants(images: DataFrame, manifest: DataFrame | None, hash_size: int = 8, compute: Callable[[DataFrame, int], DataFrame] = imaging.hash_images) -> DataFrame:
    """images(rel_path, mtime_ns, size, more) with hash_words and reused: the manifest's hashes where they are valid; ``compute`` hashes only the others."""
    if manifest is None:
        return compute(images, hash_size).withColumn("reused", F.lit(False))
    hits, misses = replace.split_hashes(images, manifest, hash_size)
    made = compute(misses, hash_size).withColumn("reused", F.lit(False))
    hits = hits.withColumns({"reused": F.lit(True), "hash_size": F.lit(hash_size)})
    return hits.select(*made.columns).unionByName(made)


def consolidate_variants(
    images: DataFrame,
    small: int = 256,
    large: int = 256,
    hash_size: int = 8,
    threshold: int = 6,
    manifest: DataFrame | None = None,
    compute: Callable[[DataFrame, int], DataFrame] = imaging.hash_images,
) -> Consolidation:
    """The replacement plan of decoded images(rel_path, stem, ext, width, height, channels, data and, with a manifest, mtime_ns and size).

    Only ID groups that have both a small and a large image are hashed, and of those only images that
    ``manifest`` (rel_path, mtime_ns, size, hash, hash_size of the last run) has no valid hash for.
    """
    hashing.check_threshold(threshold, hash_size)
    rows = candidates(images)
    usable = similarity.usable_groups(rows, small, large)
    # Kept, as the plan and the manifest read it several times and images must be decoded once.
    hashed = similarity.with_dims(hashed_variants(rows.join(usable, "id_key", "left_semi"), manifest, hash_size, compute)).persist()
    known = [c for c in ("mtime_ns", "size") if c in hashed.columns]
    made = hashed.select("rel_path", *known, hashing.hash_to_hex(F.col("hash_words")).alias("hash"), F.lit(hash_size).alias("hash_size"))
    return Consolidation(replace.id_replace_plan(hashed, small, large, hash_size, threshold), hashed, made)


def consolidate_folder(
    spark: SparkSession,
    root: str,
    small: int = 256,
    large: int = 256,
    hash_size: int = 8,
    threshold: int = 6,
    manifest: DataFrame | None = None,
    decoders: Mapping[str, Decoder] | None = None,
) -> Consolidation:
    """The replacement plan of the images below root, planned on metadata: pixels never move, and few are made.

    Names choose the candidates and headers give their sizes, so groups that lack a side are dropped before
    anything is decoded; only files without a valid hash in ``manifest`` are opened again, decoded and
    hashed, in one task each. Files without a size in their header, or that can't be decoded, are in ``failed``.
    """
    hashing.check_threshold(threshold, hash_size)
    sized = stored(listing.with_dims(candidates(listing.list_catalog(spark, root)), root), "variants")
    known = sized.filter("width is not null")
    wanted = stored(known.join(similarity.usable_groups(known, small, large), "id_key", "left_semi"), "usable")
    misses, hits = wanted, None
    if manifest is not None:
        hits, misses = replace.split_hashes(wanted, manifest, hash_size)
    pixels = catalog.decoded_from(spark, root, misses.drop("width", "height"), decoders)
    rows = stored(imaging.hash_images(pixels, hash_size).withColumn("reused", F.lit(False)), "hashes")
    made = rows.filter("hash_words is not null").drop("message")
    if hits is not None:
        hits = hits.withColumns({"reused": F.lit(True), "hash_size": F.lit(hash_size)})
        made = hits.select(*made.columns).unionByName(made)
    hashed = similarity.with_dims(made)
    failed = sized.filter("width is null").select("rel_path", F.lit("no size in its header").alias("message"))
    failed = failed.unionByName(rows.filter("hash_words is null").select("rel_path", "message"))
    next_ = hashed.select("rel_path", "mtime_ns", "size", hashing.hash_to_hex(F.col("hash_words")).alias("hash"), "hash_size")
    return Consolidation(replace.id_replace_plan(hashed, small, large, hash_size, threshold), hashed, next_, failed)
