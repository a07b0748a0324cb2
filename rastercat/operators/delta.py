"""Change detection between catalogues, and the sync plans that follow from it. Metadata only: no content is moved here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastercat.functions import paths

UNKNOWN = -1


def classify_delta(src: DataFrame, mid: DataFrame, time: str = "mtime_ns", unknown: Column | None = None) -> DataFrame:
    """Image rows of src with status: ineligible, new, updated or up_to_date against mid(rel_path, time).

    A null time in mid counts as older than any.
    """
    unknown = F.lit(UNKNOWN) if unknown is None else unknown
    known = mid.select("rel_path", F.coalesce(time, unknown).alias("mid_time"), F.lit(True).alias("in_mid"))
    joined = src.filter(paths.is_image(F.col("ext"))).join(known, "rel_path", "left")
    status = (
        F.when(~paths.is_eligible(F.col("stem")), "ineligible")
        .when(F.col("in_mid").isNull(), "new")
        .when(F.col(time) > F.col("mid_time"), "updated")
        .otherwise("up_to_date")
    )
    return joined.withColumn("status", status).drop("in_mid")


def stage_pending(delta: DataFrame) -> DataFrame:
    """Rows to transform, new and updated ones."""
    return delta.filter(F.col("status").isin("new", "updated"))


def pending_union(src: DataFrame, mid: DataFrame, time: str = "mtime_ns") -> DataFrame:
    """The same rows as a tagged union: those that mid lacks, and those that are newer than mid's."""
    images = src.filter(paths.is_image(F.col("ext")) & paths.is_eligible(F.col("stem")))
    new = images.join(mid.select("rel_path"), "rel_path", "left_anti").withColumn("status", F.lit("new"))
    older = mid.select("rel_path", F.coalesce(F.col(time), F.lit(UNKNOWN)).alias("__mid")) if time == "mtime_ns" else mid.select("rel_path", F.col(time).alias("__mid"))
    newer = images.join(older, "rel_path").filter(F.col(time) > F.col("__mid")).drop("__mid").withColumn("status", F.lit("updated"))
    return new.unionByName(newer)


def restore_times(outputs: DataFrame, src: DataFrame, time: str = "mtime_ns") -> DataFrame:
    """Outputs with their source's time; outputs without a source are left out."""
    return outputs.drop(time).join(src.select("rel_path", time), "rel_path")


def stage_counts(delta: DataFrame) -> DataFrame:
    """One row: new, updated, up_to_date, ineligible and to_process."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = delta.agg(n("new"), n("updated"), n("up_to_date"), n("ineligible"))
    return counts.withColumn("to_process", F.col("new") + F.col("updated"))


def copy_changed_plan(mid: DataFrame, dst: DataFrame, compare: str = "mtime", time: str = "mtime_ns") -> DataFrame:
    """(dst_path, src_path, reason) of files that dst lacks or has with another time (or, with 'mtime+size', another size)."""
    if compare not in ("mtime", "mtime+size"):
        raise ValueError("compare must be 'mtime' or 'mtime+size'")
    mid = paths.drop_cache_files(mid)
    there = dst.select("rel_path", F.col(time).alias("dst_time"), F.lit(True).alias("in_dst"), *([F.col("size").alias("dst_size")] if compare == "mtime+size" else []))
    joined = mid.join(there, "rel_path", "left")
    differs = ~F.col(time).eqNullSafe(F.col("dst_time"))
    if compare == "mtime+size":
        differs = differs | ~F.col("size").eqNullSafe(F.col("dst_size"))
    missing = F.col("in_dst").isNull()
    planned = joined.filter(missing | differs)
    return planned.select(F.col("rel_path").alias("dst_path"), F.col("rel_path").alias("src_path"), F.when(missing, "copy_new").otherwise("copy_changed").alias("reason"))


def mirror_plan(mid: DataFrame) -> DataFrame:
    """Everything but cache files; extra files in dst stay."""
    return paths.drop_cache_files(mid).select(F.col("rel_path").alias("dst_path"), F.col("rel_path").alias("src_path"), F.lit("mirror").alias("reason"))


def extra_files(mid: DataFrame, dst: DataFrame) -> DataFrame:
    """What dst has and mid lacks; a report only."""
    return dst.join(mid.select("rel_path"), "rel_path", "left_anti").select("rel_path")
