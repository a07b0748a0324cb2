"""The incremental refresh of snapshots, applied: what is new is transformed, variants and mips are replaced, and the result is synced.

Every step commits what it changes to a snapshot, as a version; a run that is stopped and started again,
or sees the same files again, ends in the same rows. Failures of a file are rows of the report, and the rest goes on.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.jobs.consolidate import Consolidation
from rastercat.jobs.incremental import run_incremental
from rastercat.operators import delta, report
from rastercat.sources import snapshots
from rastercat.sources.outputs import planned_contents
from rastercat.sources.scratch import dropped, stored

#: Tables of state beside mid: mip groups, and hashes.
GROUPS, HASHES = "mip_groups", "id_hashes"


@dataclass
class Report:
    """summary and status: one row each; failed: (rel_path, stage, message); groups and hashes: manifests for the next run."""

    summary: DataFrame
    failed: DataFrame
    status: DataFrame
    groups: DataFrame
    hashes: DataFrame | None


def _transformed(src: DataFrame, pending: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rel_path, content, message of every pending file, written once: transforming is what costs."""
    made = transform(src.join(pending.select("rel_path"), "rel_path", "left_semi").select("rel_path", "mtime_ns", "content"))
    return stored(made.select("rel_path", "content", "message"), "transformed")


def refresh(
    src: DataFrame,
    mid_root: str,
    dst_root: str,
    transform: Callable[[DataFrame], DataFrame],
    consolidate: Callable[..., Consolidation] | None = None,
    manifest: DataFrame | None = None,
    clean: bool = False,
    compare: str = "mtime",
    batch: tuple[str, int] | None = None,
) -> Report:
    """Refresh the snapshots at mid_root and dst_root from src(rel_path, dir, name, stem, ext, mtime_ns, size, content).

    ``transform`` makes (rel_path, content, message) of rows(rel_path, mtime_ns, content): a file with
    no content has failed, with a message. Outputs take the source's time. ``consolidate`` turns ID
    replacement on: it gets the rows of mid and returns ``consolidate_variants``'s result; if it takes a
    ``manifest``, it gets the hashes of the last run. ``manifest`` are the mip groups of the last run; by default
    those that it committed with mid. ``clean`` starts from an empty mid and mirrors it.

    Each step commits the rows that it changes. Mip groups and hashes are committed with the step that
    used them, so the next run sees both or neither. ``batch`` (stream, number) names a run that may come again.
    """
    spark = src.sparkSession
    before, dst = snapshots.snapshot_catalog(spark, mid_root), snapshots.snapshot_catalog(spark, dst_root)
    found = stored(delta.classify_delta(src.drop("content"), before.limit(0) if clean else before), "delta")
    pending = delta.stage_pending(found)
    made = _transformed(src, pending, transform)
    outputs = delta.restore_times(made.filter("content is not null").drop("message"), pending)
    failures = stored(made.filter("content is null").select("rel_path", "message"), "failures")
    if clean:
        snapshots.write_version(snapshots.latest_of(outputs), mid_root)
    else:
        snapshots.write_changes(outputs, mid_root)
    dropped(made)

    known = {} if clean else {name: snapshots.read_table(spark, mid_root, name) for name in (GROUPS, HASHES)}
    mid, rows = snapshots.snapshot_catalog(spark, mid_root), snapshots.read_snapshot(spark, mid_root)
    variants = None
    if consolidate:
        more = {"manifest": known.get(HASHES)} if "manifest" in inspect.signature(consolidate).parameters else {}
        variants = consolidate(mid.join(rows.select("rel_path", "content"), "rel_path"), **more)
    plan = run_incremental(mid.limit(0), mid, dst, variants.hashed if variants else None, known.get(GROUPS) if manifest is None else manifest, compare=compare)
    moved, lost = planned_contents(plan.contents, rows)
    moved, lost = delta.restore_times(moved, mid), stored(lost, "lost")  # a replaced file keeps its own time
    tables = {GROUPS: plan.groups.select("gid", "base", "base_mtime", "base_size", "mips")}
    if variants and {"mtime_ns", "size"} <= set(variants.manifest.columns):
        tables[HASHES] = variants.manifest
    snapshots.write_changes(moved, mid_root, tables=tables, batch=batch)

    mid = snapshots.snapshot_catalog(spark, mid_root)
    copies = stored(delta.mirror_plan(mid) if clean else delta.copy_changed_plan(mid, dst, compare), "copies")
    unsynced = snapshots.apply_sync(copies, snapshots.read_snapshot(spark, mid_root), dst_root, batch)
    failed = report.quarantine(transform=failures, replace=lost, sync=unsynced)
    summary = report.run_summary(found, plan.groups, plan.patches, plan.replacements, copies, failed)
    return Report(summary, failed, report.final_status(failed), plan.groups.select("gid", "base", "base_mtime", "base_size", "mips"), variants.manifest if variants else None)
