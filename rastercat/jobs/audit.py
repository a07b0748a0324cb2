"""The similarity audit: low-resolution images that look like high-resolution ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rastercat.functions import hashing, imaging
from rastercat.operators import report, similarity, verify
from rastercat.sources import catalog


@dataclass
class Audit:
    matches: DataFrame
    top: DataFrame | None
    gallery: DataFrame
    bands: DataFrame
    summary: DataFrame


def audit_similar(
    hashed: DataFrame,
    images: DataFrame | None = None,
    base_size: int = 1024,
    hash_size: int = 8,
    threshold: int = 6,
    diff_limit: float = 12.0,
    limit: int | None = None,
    top_k: int | None = None,
    strict: bool = False,
) -> Audit:
    """Matches of hashed rows; with ``images`` (pixels) each match is verified by its pixel difference.

    ``strict`` drops the top-k list of a low whose best match fails verification.
    """
    hashing.check_threshold(threshold, hash_size)
    found = similarity.nearest_high(hashed, base_size, threshold, hash_size, limit)
    matches = found
    if images is not None:
        columns = found.columns
        matches = similarity.within_diff(verify.measured(found.drop("diff"), images), diff_limit).select(*columns)
    top = None
    if top_k:
        top = similarity.top_k_high(hashed, top_k, base_size, hash_size, limit)
        if strict and images is not None:
            lost = found.select("low_path").join(matches.select("low_path"), "low_path", "left_anti")
            top = top.join(lost, "low_path", "left_anti")
        if images is not None:
            measured = verify.measured(top.select("low_path", "high_path"), images)
            top = top.join(measured, ["low_path", "high_path"], "left")
    return Audit(matches, top, report.gallery_index(matches), similarity.match_bands(matches), report.audit_summary(hashed, matches, base_size))


def hashed_folder(images: DataFrame, hash_size: int = 8) -> DataFrame:
    """Decoded non-mip images as hashed rows."""
    return similarity.with_dims(imaging.hash_images(catalog.non_mip(images), hash_size))
