"""The incremental refresh of a texture folder as plans over catalogues.

Catalogues have rel_path, dir, name, stem, ext, mtime_ns and size. Nothing is applied here: every
result is a DataFrame, so a dry run is a run whose plans are not applied. What several plans read - the
changes, the catalogue after them, replacements and mip groups - is made once and stored as a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.operators import delta as delta_ops
from rastercat.operators import mips, replace, report
from rastercat.sources.scratch import stored


@dataclass
class Refresh:
    delta: DataFrame
    pending: DataFrame
    mid: DataFrame
    replacements: DataFrame
    groups: DataFrame
    patches: DataFrame
    contents: DataFrame
    copies: DataFrame
    summary: DataFrame


def run_incremental(
    src: DataFrame,
    mid: DataFrame,
    dst: DataFrame,
    hashed: DataFrame | None = None,
    manifest: DataFrame | None = None,
    clean: bool = False,
    dry_run: bool = False,
    small: int = 256,
    large: int = 256,
    hash_size: int = 8,
    threshold: int = 6,
    compare: str = "mtime",
    errors: DataFrame | None = None,
) -> Refresh:
    """Plan a run: what to transform, to replace, to patch and to copy, in the order in which contents depend on each other.

    ``hashed`` (rows of mid with id_key, sizes and hash_words) turns ID replacement on. ``manifest``
    are the mip groups of the last run. ``errors`` (rel_path, message) are failures that the summary counts. ``clean`` starts from an empty mid and mirrors it.
    ``contents`` says for each changed file of mid where its bytes come from.
    """
    before = mid.limit(0) if clean else mid
    found = stored(delta_ops.classify_delta(src, before), "delta")
    pending = delta_ops.stage_pending(found)
    columns = ["rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size"]
    made = pending.select(*columns)
    after = stored(before.select(*columns).join(made.select("rel_path"), "rel_path", "left_anti").unionByName(made), "after")

    empty = after.limit(0).select(F.col("rel_path").alias("dst_path"), F.col("rel_path").alias("src_path"), F.lit("id_replace").alias("reason"))
    replacements = empty
    if hashed is not None:
        plan = replace.id_replace_plan(hashed, small, large, hash_size, threshold, near_only=True)
        replacements = stored(plan.filter("replaced").select("dst_path", "src_path", "reason"), "replacements")

    members = mips.dedupe_mips(mips.mip_members(after))
    groups = mips.with_state(mips.mip_base(mips.mip_groups(members), after))
    groups = groups.withColumn("skip", F.lit(False)) if manifest is None else mips.mip_skip(groups, manifest, dry_run)
    groups = stored(groups, "groups")  # the patch plan, the summary and the next manifest all read it
    patches = mips.mip_patch_plan(groups)
    contents = replace.composed_sources(replacements, patches)
    copies = delta_ops.mirror_plan(after) if clean else delta_ops.copy_changed_plan(after, dst, compare)
    summary = report.run_summary(found, groups, patches, replacements, copies, errors)
    return Refresh(found, pending, after, replacements, groups, patches, contents, copies, summary)
