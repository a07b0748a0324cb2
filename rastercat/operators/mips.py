"""Mip chains: groups, gaps, base images, what a manifest lets skip, and the patch plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.functions import paths

KEYS = ["dir", "base_name", "prefix", "suffix", "ext"]


def mip_members(catalog: DataFrame) -> DataFrame:
    """Mip files with their keys; ``ext`` is lower-cased, so that it is part of the group."""
    mips = paths.with_mip_keys(catalog.filter(paths.is_mip(F.col("stem")) & paths.is_image(F.col("ext"))))
    return mips.withColumn("ext", F.lower("ext")).filter("mip is not null")


def dedupe_mips(members: DataFrame, scan_order: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """One file for each group and number: the last scanned.

    The files of a group come together, by what ``mip_base`` looks up, so that neither it nor ``mip_groups`` moves them
    again. Keys that follow from a name are made anew where it arrives, instead of being moved.
    """
    moved = members.drop("prefix", "mip", "suffix", "mip_key", "gid").repartition("dir", "base_name")
    members = paths.with_mip_keys(moved.withColumnRenamed("base_name", "__base")).drop("base_name").withColumnRenamed("__base", "base_name")
    last = Window.partitionBy(*KEYS, "mip").orderBy(*(F.col(c).desc() for c in scan_order))
    return members.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def mip_groups(members: DataFrame) -> DataFrame:
    """One row a group: gid, base_name, n_mips, min_mip, max_mip, first_path (of the least mip) and members by mip, with mtime_ns and size where members have them.

    members are one file for each number (``dedupe_mips``); a chain is a handful of files.
    """
    known = [c for c in ("mtime_ns", "size") if c in members.columns]
    return members.groupBy(*KEYS).agg(
        F.first("gid").alias("gid"),
        F.first("mip_key").alias("mip_key"),
        F.count("*").alias("n_mips"),
        F.min("mip").alias("min_mip"),
        F.max("mip").alias("max_mip"),
        F.min_by("rel_path", "mip").alias("first_path"),
        F.sort_array(F.collect_list(F.struct("mip", "rel_path", *known))).alias("members"),
    )


def has_gaps() -> Column:
    """Whether a group's numbers are not contiguous; numbers may be as large as they are."""
    return F.col("max_mip") - F.col("min_mip") != F.col("n_mips") - 1


def mip_gaps(groups: DataFrame) -> DataFrame:
    """Groups whose numbers are not contiguous, with the missing ones as ranges (first, last): there may be very many."""
    broken = groups.filter(has_gaps())
    numbers = F.transform("members", lambda m: m["mip"])
    n = F.size(numbers)
    steps = F.zip_with(F.slice(numbers, F.lit(1), n - 1), F.slice(numbers, F.lit(2), n - 1), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return broken.withColumn("missing", F.filter(steps, lambda x: x["first"] <= x["last"]))


def mip_base(groups: DataFrame, catalog: DataFrame) -> DataFrame:
    """Groups with base: the file of their directory that has exactly base_name, or else the member of least number; and its base_mtime and base_size, where known.

    The wanted name has the lower-case extension and is looked up by case. A base is a mip file itself only where a name
    has two mip numbers; while no file of the catalogue has such a name, only the others are moved and looked up.
    """
    stem = paths.stem(F.col("name"))
    twice = paths.is_mip(stem) & paths.is_mip(F.concat(paths.mip_prefix(stem), paths.mip_suffix(stem)))
    if catalog.filter(twice).isEmpty():
        catalog = catalog.filter(~paths.is_mip(stem))
    known = [c for c in ("mtime_ns", "size") if c in catalog.columns and c in groups.schema["members"].dataType.elementType.names]
    files = catalog.select("dir", F.col("name").alias("base_name"), F.struct("rel_path", *known).alias("found")).groupBy("dir", "base_name").agg(F.min("found").alias("found"))
    first = F.get("members", F.lit(0))
    own = lambda c: F.when(F.col("found").isNotNull(), F.col(f"found.{c}")).otherwise(first[c])
    names = {"rel_path": "base", "mtime_ns": "base_mtime", "size": "base_size"}
    return groups.join(files, ["dir", "base_name"], "left").withColumns({names[c]: own(c) for c in ("rel_path", *known)}).drop("found")


def with_state(groups: DataFrame) -> DataFrame:
    """Based groups with mips (sorted path and time), as a manifest records them beside base_mtime and base_size."""
    return groups.withColumn("mips", F.sort_array(F.transform("members", lambda m: F.struct(m["rel_path"].alias("path"), m["mtime_ns"].alias("mtime")))))


def mip_skip(state: DataFrame, manifest: DataFrame, dry_run: bool = False) -> DataFrame:
    """state with skip: whether the manifest shows the group unchanged.

    Base time and size, the set of mip paths and each mip's time must agree; a group without mips in
    the manifest, or with a base that is no string, never skips. The base's path is not compared.
    """
    known = manifest.select("gid", F.col("base").isNotNull().alias("m_base"), F.col("base_mtime").alias("m_mtime"), F.col("base_size").alias("m_size"), F.sort_array("mips").alias("m_mips"))
    columns = state.columns
    if "members" in columns:  # they have all that mips has: paths are moved once
        joined = with_state(state.drop("mips").join(known, "gid", "left"))
    else:
        joined = state.join(known, "gid", "left")
    same: Column = (
        F.col("m_base")
        & (F.col("base_mtime") == F.col("m_mtime"))
        & (F.col("base_size") == F.col("m_size"))
        & (F.size("m_mips") > 0)
        & (F.col("mips") == F.col("m_mips"))
    )
    skip = F.lit(False) if dry_run else F.coalesce(same, F.lit(False))
    return joined.withColumn("skip", skip).select(*columns, "skip")


def same_path_sets(a: Column, b: Column) -> Column:
    """Whether two arrays of paths hold the same set."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def mip_patch_plan(groups: DataFrame) -> DataFrame:
    """(dst_path, src_path, reason): every member but the base takes the base's content, in groups that are not skipped."""
    rows = (groups.filter("not skip") if "skip" in groups.columns else groups).select("base", F.explode("members").alias("m"))
    return rows.filter("m.rel_path <> base").select(F.col("m.rel_path").alias("dst_path"), F.col("base").alias("src_path"), F.lit("mip_patch").alias("reason"))
