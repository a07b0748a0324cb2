"""Folders listed, and files opened, inside tasks: no list of files on the driver, and only bytes that are wanted are read.

Roots are paths on a mounted disk, or addresses that Arrow's file systems open. Where neither is so,
``catalog.scan_files`` reads through Spark's own readers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat.functions import paths
from rastercat.functions.decoders import image_size
from rastercat.sources.scratch import stored

#: Bytes at the front of a file in which its size is looked for first.
HEAD = 1 << 16
#: Bytes that a task reads about, and that it hands on at once.
SHARE, BATCH = 1 << 27, 1 << 25


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of root and the path there, without a slash at its end."""
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    return system, base.rstrip("/")


def _absolute(root: str) -> str:
    return root if "://" in root or root.startswith("file:") else os.path.abspath(root)


def hidden(name: str) -> bool:
    """Names that Spark's file readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_folder(system: fs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(rel_path, is_dir, mtime_ns, size) of what lies in one folder; none if it has gone meanwhile."""
    for info in system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base or "/", allow_not_found=True)):
        if not hidden(info.base_name) and info.type in (fs.FileType.File, fs.FileType.Directory):
            path = f"{folder}/{info.base_name}" if folder else info.base_name
            yield path, info.type == fs.FileType.Directory, info.mtime_ns or 0, info.size or 0


def _parts(spark: SparkSession, rows: int) -> int:
    return max(1, min(rows, 4 * spark.sparkContext.defaultParallelism))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below root, as ``catalog.scan_files`` gives it, with times in whole nanoseconds.

    Folders are rows: each pass lists the folders of a level in tasks and stores what they hold, so the
    driver knows how many there are and nothing more. A folder's own files are listed in one task.
    """
    root = _absolute(root)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for row in list_folder(system, base, folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _listed(rows)
                        rows = []
                if rows:
                    yield _listed(rows)

    levels, folders, many = [], spark.createDataFrame([("",)], "rel_path string"), 1
    while many:
        dealt = folders.repartition(_parts(spark, many))
        found = stored(dealt.mapInArrow(work, "rel_path string, is_dir boolean, mtime_ns long, size long"), "listing")
        levels.append(found.filter("not is_dir").drop("is_dir"))
        folders = found.filter("is_dir").select("rel_path")
        many = folders.count()
    files = reduce(DataFrame.unionByName, levels)
    return paths.with_path_parts(files).select("rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["rel_path", "is_dir", "mtime_ns", "size"])


def list_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Image files only, by extension in any case."""
    return list_files(spark, root).filter(paths.is_image(F.col("ext")))


def _dealt(files: DataFrame, share: int | None) -> DataFrame:
    """Files over as many tasks as their bytes, or else their number, need."""
    many, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = _parts(files.sparkSession, many)
    return files.repartition(max(parts, -(-size // share)) if share else max(parts, many // 10_000), "rel_path")


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """files(rel_path, size, more) with content: only these files are opened. One that can't be read has none, and a message."""
    root = _absolute(root)
    dealt = _dealt(files, SHARE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            at, names = 0, batch.column(batch.schema.get_field_index("rel_path")).to_pylist()
            content, message, size = [], [], 0
            for k, name in enumerate(names):
                try:
                    with system.open_input_file(f"{base}/{name}") as f:
                        content.append(f.read())
                    message.append(None)
                    size += len(content[-1])
                except OSError as e:
                    content.append(None)
                    message.append(f"can't be read: {type(e).__name__}")
                if size > BATCH or k == len(names) - 1:
                    some = batch.slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(content, pa.binary()), pa.array(message, pa.string())], names=[*batch.schema.names, "content", "message"])
                    at, content, message, size = k + 1, [], [], 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return dealt.mapInArrow(work, f"{fields}, content binary, message string")


def with_dims(files: DataFrame, root: str) -> DataFrame:
    """files(rel_path, ext, size, more) with width and height from their headers: nothing is decoded, and few files are read beyond their first ``HEAD`` bytes. Null where there is no size."""
    root = _absolute(root)
    dealt = _dealt(files, None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            names, exts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rel_path", "ext"))
            sizes = [_size_of(system, f"{base}/{name}", ext or "") for name, ext in zip(names, exts, strict=True)]
            dims = [pa.array([s and s[k] for s in sizes], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *dims], names=[*batch.schema.names, "width", "height"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return dealt.mapInArrow(work, f"{fields}, width int, height int")


def _size_of(system: fs.FileSystem, path: str, ext: str) -> tuple[int, int] | None:
    try:
        with system.open_input_file(path) as f:
            data = f.read(HEAD)
            try:
                return image_size(data, ext)
            except EOFError:
                return image_size(data + f.read(), ext)
    except (OSError, EOFError):
        return None
