"""Where results between passes are kept, how lineage is cut, and names for columns inside."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it names none, a session in one process (a local master, as in tests) gets a local one; a
    cluster's executors would not share that, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: later passes neither recompute it nor depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it clash with no column of df, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = "__" + name
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def kinds(df: DataFrame) -> list[str]:
    """The types of the columns of df."""
    return [f.dataType.simpleString() for f in df.schema]


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str], types: list[str]) -> DataFrame:
    """df.mapInArrow(work) with columns of these names, which may have any characters, and types; work goes by place alone."""
    plain = [f"c{k}" for k in range(len(names))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield batch.rename_columns(plain)

    given = df.toDF(*(f"g{k}" for k in range(len(df.columns))))
    return given.mapInArrow(renamed, ", ".join(f"{c} {t}" for c, t in zip(plain, types, strict=True))).toDF(*names)


def column(name: str) -> str:
    """A column's name as a reference, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"
