"""New dumps as they appear: a stream of listing rows, each micro-batch an incremental run.

A stream of the image folder itself would not deliver a path again when its content changes, so the
stream is of append-only listing rows (rel_path, mtime_ns, size). The checkpoint delivers each row
once; the time comparison decides what is done, so a row that comes twice does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rastercat.functions import paths
from rastercat.jobs.incremental import Refresh, run_incremental
from rastercat.jobs.refresh import Report, refresh

LISTING = "rel_path string, mtime_ns bigint, size bigint"


def newest_listing(batch: DataFrame) -> DataFrame:
    """One catalogue row for each path: the newest."""
    newest = batch.groupBy("rel_path").agg(F.max(F.struct("mtime_ns", "size")).alias("x")).select("rel_path", "x.*")
    return paths.with_path_parts(newest).select("rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size")


def stream_incremental(listing: DataFrame, mid: Callable[[], DataFrame], dst: Callable[[], DataFrame], apply: Callable[[Refresh, int], None], checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Plan each micro-batch against the catalogues as they are then, and hand the plans to ``apply(refresh, batch_id)``.

    ``apply`` may see a batch again after a failure; it must give the same result then, as ``refresh``
    does. ``trigger`` is what ``DataStreamWriter.trigger`` takes, {"processingTime": "1 minute"} to go on
    watching; without one the stream ends with what is there.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        apply(run_incremental(newest_listing(batch), mid(), dst(), **options), batch_id)

    return listing.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_refresh(
    listing: DataFrame,
    contents: Callable[[DataFrame], DataFrame],
    mid_root: str,
    dst_root: str,
    transform: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    report: Callable[[Report, int], None] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """``refresh`` of every micro-batch: ``contents`` adds the content of the files that a catalogue lists; snapshots hold the result.

    Mip groups and hashes go from batch to batch with mid, so only groups that changed are patched and only images
    that changed are hashed. A batch that comes again after a failure ends in the same rows and the same state.
    ``trigger`` as in ``stream_incremental``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        got = refresh(contents(newest_listing(batch)), mid_root, dst_root, transform, batch=(checkpoint, batch_id), **options)
        if report:
            report(got, batch_id)

    return listing.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
