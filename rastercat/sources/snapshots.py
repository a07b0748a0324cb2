"""Snapshots as a log of what changed: a run writes the rows that it changes, and readers merge them.

A snapshot is a folder. ``data`` has a folder for each write, partitioned by a hash of the path into buckets; ``log``
has a small file for each version, named by its number, which lists the parts that make the snapshot up:
folders, oldest first, with the buckets that are still read from each, and the tables of state that were committed
with it. The newest row of a path counts. A version is there when its file is, and the file is made in one
step that fails where it exists: of two writers of one number, one loses and either takes the next
number or, if it depends on what it read, raises ``Conflict``. Half-written folders are in no version.

``compact`` rewrites buckets in which changes have piled up; ``drop_old_versions`` deletes what no kept version reads.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat.functions import paths
from rastercat.sources.outputs import planned_contents

SCHEMA = "rel_path string, mtime_ns bigint, size bigint, content binary"
CATALOG = "rel_path string, dir string, name string, stem string, ext string, mtime_ns bigint, size bigint"
_STORED = f"{SCHEMA}, gone boolean, bucket int"

#: Buckets of a new snapshot; it keeps its number.
BUCKETS = 64
#: Changed paths that are broadcast to the rows that they replace; more are joined by a shuffle.
BROADCAST = 1 << 20


class Conflict(Exception):
    """Another version was committed since the one that this one was made from."""


# --- versions ------------------------------------------------------------------------------------------


def _files(spark: SparkSession, root: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    return hadoop, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions, oldest first."""
    hadoop, path, system = _files(spark, root)
    log = hadoop.Path(path, "log")
    if not system.exists(log):
        return []
    names = (status.getPath().getName() for status in system.listStatus(log))
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))


def _name(version: int) -> str:
    return f"log/{version:012d}.json"


def _text(spark: SparkSession, root: str, name: str) -> str:
    hadoop, path, system = _files(spark, root)
    stream = system.open(hadoop.Path(path, name))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def state(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """A version, the newest by default: version, parts, batches (the last one of each stream), tables (of state) and buckets. Version -1 is before any."""
    if version is None:
        version = max(versions(spark, root), default=-1)
    if version < 0:
        return {"version": -1, "parts": [], "batches": {}, "tables": {}, "buckets": BUCKETS}
    return json.loads(_text(spark, root, _name(version)))


def _created(spark: SparkSession, root: str, name: str, text: str) -> bool:
    """Make a file that is whole as soon as it can be seen; False if there is one. On a local disk by a link, elsewhere by a rename that never overwrites."""
    hadoop, path, system = _files(spark, root)
    hidden, wanted = hadoop.Path(path, f"log/.{uuid.uuid4().hex}"), hadoop.Path(path, name)
    system.mkdirs(hadoop.Path(path, "log"))
    stream = system.create(hidden, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(hidden.toUri().getPath(), wanted.toUri().getPath())
        else:
            none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(system.makeQualified(hidden), system.makeQualified(wanted), options)
        return True
    except FileExistsError:
        return False
    except Exception:
        if system.exists(wanted):
            return False
        raise
    finally:
        system.delete(hidden, False)


def commit(spark: SparkSession, root: str, change, after: int | None = None, batch: tuple[str, int] | None = None) -> int:
    """Commit what ``change(state)`` makes of the newest version's state; returns its number.

    ``after``: the version that the change was made from; ``Conflict`` if it isn't the newest any more. Without it, a
    writer that comes second changes the version of the first. ``batch``: (stream, number); a batch that
    was committed before, or one before it, is not committed again, and its stream's last version is returned.
    """
    while True:
        now = state(spark, root)
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now["version"]
        if after is not None and now["version"] != after:
            raise Conflict(f"version {now['version']} came after {after}")
        new = change(now) | {"version": now["version"] + 1, "buckets": now["buckets"]}
        if batch:
            new["batches"] = now["batches"] | {batch[0]: batch[1]}
        if _created(spark, root, _name(new["version"]), json.dumps(new)):
            return new["version"]


# --- reading -------------------------------------------------------------------------------------------


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _part(spark: SparkSession, root: str, part: dict) -> DataFrame:
    rows = spark.read.schema(_STORED).parquet(f"{root.rstrip('/')}/{part['folder']}")
    return rows if part["buckets"] is None else rows.filter(F.col("bucket").isin(*part["buckets"]))


def _merged(spark: SparkSession, root: str, now: dict) -> DataFrame:
    """The newest row of each path, without those that are gone. Rows of the oldest parts stay where they are if few paths have changed."""
    if not now["parts"]:
        return spark.createDataFrame([], _STORED)
    # Parts that share no bucket hold different paths, so all but the first of a bucket are changes.
    whole, changes, seen = [], [], set()
    for part in now["parts"]:
        own = set(range(now["buckets"]) if part["buckets"] is None else part["buckets"])
        (changes if own & seen else whole).append(part)
        seen |= own
    old = reduce(DataFrame.unionByName, (_part(spark, root, p) for p in whole))
    if changes:
        new = reduce(DataFrame.unionByName, (_part(spark, root, p).withColumn("__n", F.lit(k)) for k, p in enumerate(changes)))
        newest = new.groupBy("rel_path").agg(F.max("__n").alias("__n"))
        small = sum(p["rows"] for p in changes) <= BROADCAST
        keys = F.broadcast(newest) if small else newest
        old = old.join(keys.select("rel_path"), "rel_path", "left_anti").unionByName(new.join(keys, ["rel_path", "__n"], "left_semi").drop("__n"))
    return old.filter("not gone")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """rel_path, mtime_ns, size and content of a version, by default the newest; an empty table where there is none."""
    return _merged(spark, root, state(spark, root, version)).select("rel_path", "mtime_ns", "size", "content")


def snapshot_catalog(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version as a catalogue; contents are not read."""
    rows = read_snapshot(spark, root, version).select("rel_path", "mtime_ns", "size")
    return paths.with_path_parts(rows).select(*(c.split()[0] for c in CATALOG.split(", ")))


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table of state that was committed with a version; None where there is none."""
    folder = state(spark, root, version)["tables"].get(name)
    return None if folder is None else spark.read.parquet(f"{root.rstrip('/')}/{folder}")


# --- writing -------------------------------------------------------------------------------------------


def _written(rows: DataFrame, root: str, buckets: int) -> dict:
    """A new folder of rows(rel_path, mtime_ns, size, content, gone) as a part of all buckets. Its files are of even sizes, a few for a bucket."""
    folder = f"data/{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{folder}"
    placed = rows.select("rel_path", "mtime_ns", "size", "content", "gone", bucket_of(F.col("rel_path"), buckets).alias("bucket"))
    placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return {"folder": folder, "rows": rows.sparkSession.read.schema(_STORED).parquet(path).count(), "buckets": None}


def _tables(spark: SparkSession, root: str, tables: dict[str, DataFrame] | None) -> dict[str, str]:
    out = {}
    for name, table in (tables or {}).items():
        out[name] = f"state/{name}-{uuid.uuid4().hex}"
        table.write.parquet(f"{root.rstrip('/')}/{out[name]}")
    return out


def latest_of(rows: DataFrame) -> DataFrame:
    """One of rows(rel_path, mtime_ns, content) for each path: the newest."""
    one = rows.groupBy("rel_path").agg(F.max_by(F.struct("mtime_ns", "content"), F.struct("mtime_ns", F.xxhash64("content"))).alias("x"))
    return one.select("rel_path", "x.mtime_ns", F.octet_length("x.content").cast("bigint").alias("size"), "x.content", F.lit(False).alias("gone"))


def write_version(rows: DataFrame, root: str, after: int | None = None, tables: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None) -> int:
    """Commit rows(rel_path, mtime_ns, size, content) in place of all others; returns the version."""
    spark = rows.sparkSession
    part = _written(rows.select("rel_path", "mtime_ns", "size", "content", F.lit(False).alias("gone")), root, state(spark, root)["buckets"])
    made = _tables(spark, root, tables)
    return commit(spark, root, lambda now: now | {"parts": [part], "tables": now["tables"] | made}, after, batch)


def write_changes(
    rows: DataFrame, root: str, gone: DataFrame | None = None, after: int | None = None, tables: dict[str, DataFrame] | None = None, batch: tuple[str, int] | None = None
) -> int:
    """Commit rows(rel_path, mtime_ns, content), each in place of the row of its path, and drop the paths of gone(rel_path); returns the version.

    What is written is these rows and nothing else. Where there is nothing to write, and no table, no version is made.
    """
    spark = rows.sparkSession
    new = latest_of(rows)
    if gone is not None:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("mtime_ns", "bigint"), ("size", "bigint"), ("content", "binary"))]
        lost = gone.select("rel_path").distinct().join(new.select("rel_path"), "rel_path", "left_anti")
        new = new.unionByName(lost.select("rel_path", *empty, F.lit(True).alias("gone")))
    now = state(spark, root)
    part = _written(new, root, now["buckets"])
    if not part["rows"]:
        _delete(spark, root, part["folder"])
        if not tables and not batch:
            return now["version"]
    parts = [part] if part["rows"] else []
    made = _tables(spark, root, tables)
    version = commit(spark, root, lambda now: now | {"parts": now["parts"] + parts, "tables": now["tables"] | made}, after, batch)
    kept = state(spark, root, version)
    # A batch that was committed before leaves nothing new behind.
    _delete(spark, root, *(p["folder"] for p in parts if p not in kept["parts"]), *(f for f in made.values() if f not in kept["tables"].values()))
    return version


def apply_sync(plan: DataFrame, contents: DataFrame, root: str, batch: tuple[str, int] | None = None) -> DataFrame:
    """Put the planned files into the snapshot at root; returns (rel_path, message) of failures.

    A planned file takes the place of the row of its path; all other rows stay where they are. Applying a plan again
    gives the same rows.
    """
    rows, failed = planned_contents(plan, contents)
    write_changes(rows, root, batch=batch)
    return failed


# --- upkeep --------------------------------------------------------------------------------------------


def compact(spark: SparkSession, root: str, share: float = 0.25, most: int = 16) -> int | None:
    """Rewrite the buckets whose changes are over this share of their rows, or all where there are over ``most`` parts; returns the version, None if nothing was due.

    Raises ``Conflict`` where another version comes meanwhile: the rows that it changed could be lost.
    """
    now = state(spark, root)
    if len(now["parts"]) < 2:
        return None
    counts = reduce(DataFrame.unionByName, (_part(spark, root, p).groupBy("bucket").count().withColumn("part", F.lit(k)) for k, p in enumerate(now["parts"]))).collect()  # buckets x parts
    rows = {b: {r["part"]: r["count"] for r in counts if r["bucket"] == b} for b in {r["bucket"] for r in counts}}
    due = sorted(b for b, of in rows.items() if len(of) > 1 and (len(now["parts"]) > most or sum(of.values()) - max(of.values()) > share * max(of.values())))
    if not due:
        return None
    merged = _merged(spark, root, now).filter(F.col("bucket").isin(*due))
    part = _written(merged.drop("bucket"), root, now["buckets"]) | {"buckets": due}

    def change(now: dict) -> dict:
        parts = []
        for k, p in enumerate(now["parts"]):
            left = [b for b in (range(now["buckets"]) if p["buckets"] is None else p["buckets"]) if b not in due]
            if any(k in rows.get(b, ()) for b in left):  # else it has no rows that are still read
                parts.append(p | {"buckets": left})
        return now | {"parts": [*parts, part]}

    try:
        return commit(spark, root, change, after=now["version"])
    except Conflict:
        _delete(spark, root, part["folder"])
        raise


def _delete(spark: SparkSession, root: str, *names: str) -> None:
    hadoop, path, system = _files(spark, root)
    for name in names:
        system.delete(hadoop.Path(path, name), True)


def _folders(version: dict) -> Iterable[str]:
    return {*(p["folder"] for p in version["parts"]), *version["tables"].values()}


def drop_old_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, and the folders that none of these reads: only for versions that no running job reads."""
    known = versions(spark, root)
    old, kept = known[: -max(1, keep)], known[-max(1, keep) :]
    used = set().union(*(_folders(state(spark, root, v)) for v in kept))
    for version in old:
        folders = set(_folders(state(spark, root, version))) - used
        _delete(spark, root, _name(version), *sorted(folders))
