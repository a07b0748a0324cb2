"""What a run remembers: mip groups and hashes. JSON manifests are read; tables are written.

A manifest that is missing, broken or of an unknown version is an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat.functions import hashing, paths
from rastercat.sources.scratch import shared_folder

MIP_VERSIONS, HASH_VERSIONS = (1, 2), (1,)
_MIP = "version int, groups map<string, struct<base: string, base_mtime_ns: bigint, base_size: bigint, mips: array<struct<path: string, mtime_ns: bigint>>>>"
_HASH = "version int, entries map<string, struct<mtime_ns: bigint, size: bigint, hash: string, hash_size: int>>"


def _visible(spark: SparkSession, path: str) -> str | None:
    """A path that Spark's readers list, or None where there is none: they pass over hidden files, so a hidden one is copied, file to file."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source = hadoop.Path(path)
    if not source.getFileSystem(conf).exists(source):
        return None
    if not source.getName().startswith((".", "_")):
        return path
    copy = hadoop.Path(shared_folder(spark), f"manifest-{uuid.uuid4().hex}.json")
    hadoop.FileUtil.copy(source.getFileSystem(conf), source, copy.getFileSystem(conf), copy, False, conf)
    return copy.toString()


def _documents(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...]) -> DataFrame:
    """Manifests as one row each; from_json makes a broken one null."""
    seen = _visible(spark, path)
    text = spark.createDataFrame([], "value string") if seen is None else spark.read.text(seen, wholetext=True)
    return text.select(F.from_json("value", schema).alias("x")).select("x.*").filter(F.col("version").isin(*versions))


def read_mip_manifest(spark: SparkSession, path: str) -> DataFrame:
    """gid, base, base_mtime, base_size, mips (sorted path and mtime; null in version 1, which never lets a group be skipped)."""
    rows = _documents(spark, path, _MIP, MIP_VERSIONS).select("version", F.explode("groups").alias("gid", "g"))
    mips = F.when(F.col("version") == 2, F.sort_array(F.transform("g.mips", lambda m: F.struct(paths.normalised_path(m["path"]).alias("path"), m["mtime_ns"].alias("mtime")))))
    return rows.select(paths.normalised_path(F.col("gid")).alias("gid"), paths.normalised_path(F.col("g.base")).alias("base"), F.col("g.base_mtime_ns").alias("base_mtime"), F.col("g.base_size").alias("base_size"), mips.alias("mips"))


def write_mip_manifest(state: DataFrame, path: str) -> None:
    """The groups of this run; groups that are gone vanish. Write to a new path each run and switch after."""
    state.select("gid", "base", "base_mtime", "base_size", "mips").write.mode("overwrite").parquet(path)


def read_hash_manifest(spark: SparkSession, path: str) -> DataFrame:
    """rel_path, mtime_ns, size, hash, hash_size."""
    rows = _documents(spark, path, _HASH, HASH_VERSIONS).select(F.explode("entries").alias("rel_path", "e"))
    return rows.select(paths.normalised_path(F.col("rel_path")).alias("rel_path"), "e.mtime_ns", "e.size", "e.hash", "e.hash_size")


def write_hash_manifest(hashed: DataFrame, path: str) -> None:
    """hashed(rel_path, mtime_ns, size, hash_words, hash_size): the files touched this run, hashes in hex without leading zeros."""
    hex_ = hashing.hash_to_hex(F.col("hash_words")).alias("hash")
    hashed.select("rel_path", "mtime_ns", "size", hex_, "hash_size").write.mode("overwrite").parquet(path)
