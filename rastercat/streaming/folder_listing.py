"""A stream of what is new in a folder: files that weren't there, and files that were dumped again.

Spark's own file stream never delivers a path twice. This source's offset is a moment at which the folder was
listed; the listing itself is kept in a state folder, one file for each top folder and moment. A batch lists each
top folder in a task of its own and delivers what differs from the listing before. A batch that comes
again, after a failure or a restart, reads the listing that it kept the first time.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rastercat.sources.listing import hidden, list_folder, opened

LISTING = "rel_path string, mtime_ns bigint, size bigint"
_ROOT = "_root"


class _Folder(InputPartition):
    def __init__(self, folder: str, start: int, end: int):
        self.folder, self.start, self.end = folder, start, end


class FolderListing(DataSource):
    """Options: path, the folder; state, a folder that driver and executors share, one for each stream."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Reader(self.options["path"], self.options["state"])


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, state: str):
        self.path, self.state = path, state

    # On the driver: moments, and the names of top folders.

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ns": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"ns": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The top folders as they were when the batch was planned first."""
        system, base = opened(self.state)
        plan = f"{base}/plans/{end['ns']}.json"
        if system.get_file_info(plan).type == fs.FileType.NotFound:
            source, root = opened(self.path)
            infos = source.get_file_info(fs.FileSelector(root, allow_not_found=True))
            names = sorted(i.base_name for i in infos if i.type == fs.FileType.Directory and not hidden(i.base_name))
            _put(system, plan, json.dumps([_ROOT, *names]).encode())
        with system.open_input_file(plan) as f:
            return [_Folder(name, start["ns"], end["ns"]) for name in json.loads(f.read())]

    def commit(self, end: dict) -> None:
        """Listings before the one that the next batch starts from are no longer needed."""
        system, base = opened(self.state)
        for folder in system.get_file_info(fs.FileSelector(f"{base}/listings", allow_not_found=True)):
            moments = _moments(system, folder.path)
            for ns in [m for m in moments if m <= end["ns"]][:-1]:
                system.delete_file(f"{folder.path}/{ns}.arrow")
        for plan in system.get_file_info(fs.FileSelector(f"{base}/plans", allow_not_found=True)):
            if int(plan.base_name.split(".")[0]) < end["ns"]:
                system.delete_file(plan.path)

    # In tasks: a top folder each.

    def read(self, partition: _Folder) -> Iterator[tuple]:
        system, base = opened(self.state)
        own = f"{base}/listings/{partition.folder}"
        now = _kept(system, f"{own}/{partition.end}.arrow")
        if now is None:
            now = dict(self._listed(partition.folder))
            _keep(system, f"{own}/{partition.end}.arrow", now)
        earlier = [m for m in _moments(system, own) if m <= partition.start]
        before = (_kept(system, f"{own}/{earlier[-1]}.arrow") if earlier else None) or {}
        for path, seen in now.items():
            if before.get(path) != seen:
                yield (path, *seen)

    def _listed(self, top: str) -> Iterator[tuple[str, tuple[int, int]]]:
        system, base = opened(self.path)
        waiting = ["" if top == _ROOT else top]
        while waiting:
            for path, is_dir, mtime, size in list_folder(system, base, waiting.pop()):
                if not is_dir:
                    yield path, (mtime, size)
                elif top != _ROOT:
                    waiting.append(path)


def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """A file that is whole as soon as it can be seen."""
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def _keep(system: fs.FileSystem, path: str, rows: dict[str, tuple[int, int]]) -> None:
    table = pa.table({"rel_path": pa.array(rows, pa.string()), "mtime_ns": pa.array([v[0] for v in rows.values()], pa.int64()), "size": pa.array([v[1] for v in rows.values()], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    _put(system, path, sink.getvalue().to_pybytes())


def _kept(system: fs.FileSystem, path: str) -> dict[str, tuple[int, int]] | None:
    try:
        with system.open_input_file(path) as f:
            table = pa.ipc.open_file(f).read_all()
    except FileNotFoundError:
        return None
    columns = [table.column(c).to_pylist() for c in ("rel_path", "mtime_ns", "size")]
    return {path: (mtime, size) for path, mtime, size in zip(*columns, strict=True)}


def _moments(system: fs.FileSystem, folder: str) -> list[int]:
    infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(int(i.base_name.split(".")[0]) for i in infos if i.base_name.endswith(".arrow"))


def stream_listing(spark: SparkSession, root: str, state: str) -> DataFrame:
    """New and changed files below root as a stream of listing rows, for ``stream_incremental`` and ``stream_refresh``."""
    spark.dataSource.register(FolderListing)
    return spark.readStream.format(FolderListing.name()).option("path", root).option("state", state).load()
