"""Catalogues and pixels from folders of images."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastercat.functions import paths
from rastercat.functions.decoders import DECODERS, Decoder, image_size
from rastercat.sources import listing


def _relative(path: Column, root: str) -> Column:
    """The path below root, whatever scheme and slashes the file system reports."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(base)), F.substring(bare, F.lit(len(base) + 1), F.length(bare))).otherwise(bare)


def scan_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Every file below root: rel_path, dir, name, stem, ext, mtime_ns, size and, if asked for, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = [_relative(F.col("path"), root).alias("rel_path"), (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns"), F.col("length").alias("size")]
    rows = files.select(*columns, *([F.col("content")] if content else []))
    parts = paths.with_path_parts(rows)
    return parts.select("rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size", *(["content"] if content else []))


def scan_catalog(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Image files only, by extension in any case."""
    return scan_files(spark, root, content).filter(paths.is_image(F.col("ext")))


def read_images(spark: SparkSession, root: str, decoders: Mapping[str, Decoder] | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, failed): a catalogue's columns with width, height, channels and data (gray or BGR[A]), and (rel_path, message) of the others.

    ``decoders``, by lower-case extension, add to or replace ``functions.decoders.DECODERS``; other images are given
    to Spark's image source, and what it doesn't know ends up in ``failed``. Times are those of ``scan_files``.
    """
    table = {**DECODERS, **(decoders or {})}
    files = scan_catalog(spark, root, content=True)
    ours = decoded(files.filter(F.lower("ext").isin(*table)), table)
    columns = ("rel_path", "dir", "name", "stem", "ext", "mtime_ns", "size", "width", "height", "channels", "data")
    others = _by_image_source(spark, root, table)
    images = ours.filter("data is not null").select(*columns).unionByName(others.filter("width > 0").select(*columns))
    failed = ours.filter("data is null").select("rel_path", "message")
    return images, failed.unionByName(others.filter("width <= 0").select("rel_path", F.lit("can't be decoded").alias("message")))


def _by_image_source(spark: SparkSession, root: str, table: Mapping[str, Decoder], load: list[str] | None = None) -> DataFrame:
    """Images whose extension isn't in the table, decoded by Spark; width is negative where it can't."""
    rest = [ext for ext in paths.IMAGE_EXTENSIONS if ext not in table]
    rows = spark.read.format("image").option("recursiveFileLookup", True)
    if rest and not load:  # in any case, as a glob
        rows = rows.option("pathGlobFilter", "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in rest) + "}")
    when = (F.unix_millis("_metadata.file_modification_time") * 1_000_000).alias("mtime_ns")
    found = rows.load(load or root).select("image.*", when, F.col("_metadata.file_size").alias("size"))
    found = paths.with_path_parts(found.withColumn("rel_path", _relative(F.col("origin"), root)))
    return found.filter(F.lower("ext").isin(*rest) if rest else F.lit(False)).withColumnRenamed("nChannels", "channels")


def decoded(files: DataFrame, decoders: Mapping[str, Decoder] = DECODERS) -> DataFrame:
    """files(ext, content, more) with width, height, channels and data instead of content; where a decoder fails, or there is none, these are null and message says why."""
    kept = [f for f in files.schema if f.name not in ("content", "message")]
    decoders = dict(decoders)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            said = column("message").to_pylist() if "message" in batch.schema.names else [None] * batch.num_rows
            for k, (ext, content) in enumerate(zip(column("ext").to_pylist(), column("content"), strict=True)):
                message, image, decoder = said[k], None, decoders.get((ext or "").lower())
                if content.is_valid and decoder:
                    try:
                        image = decoder(content.as_buffer().to_pybytes())
                    except Exception as e:  # a decoder of the caller's may raise anything
                        message = f"can't be decoded: {e}"
                elif message is None:
                    message = "can't be decoded"
                shape = (None, None, None) if image is None else (image.shape[1], image.shape[0], image.shape[2])
                own = [column(f.name).slice(k, 1) for f in kept]
                made = [pa.array([n], pa.int32()) for n in shape] + [pa.array([None if image is None else image.tobytes()], pa.binary()), pa.array([message], pa.string())]
                yield pa.RecordBatch.from_arrays(own + made, names=[*(f.name for f in kept), "width", "height", "channels", "data", "message"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return files.mapInArrow(work, f"{fields}, width int, height int, channels int, data binary, message string")


#: Files that the image source is given by name; more are found by it in the whole folder.
NAMED = 10_000


def decoded_from(spark: SparkSession, root: str, files: DataFrame, decoders: Mapping[str, Decoder] | None = None) -> DataFrame:
    """files(rel_path, ext, size, more) decoded: only these files are opened. Columns as ``decoded`` gives them.

    Formats without a decoder here are Spark's to decode: by name where they are few; otherwise it decodes all
    files of those formats below root, and only these are kept.
    """
    table = {**DECODERS, **(decoders or {})}
    ours = decoded(listing.with_contents(files.filter(F.lower("ext").isin(*table)), root), table)
    others = files.filter(~F.lower("ext").isin(*table))
    few = [r[0] for r in others.select("rel_path").limit(NAMED + 1).collect()]  # bounded
    if not few:
        return ours
    base = root.rstrip("/")
    found = _by_image_source(spark, root, table, [f"{base}/{name}" for name in few] if len(few) <= NAMED else None)
    pixels = found.filter("width > 0").select("rel_path", "width", "height", "channels", "data", F.lit(None).cast("string").alias("message"))
    joined = others.join(pixels, "rel_path", "left").withColumn("message", F.when(F.col("data").isNull(), "can't be decoded"))
    return ours.unionByName(joined.select(*ours.columns))


def header_dims(files: DataFrame) -> DataFrame:
    """files(ext, content, more) with width and height from headers, without decoding; null where there are none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ext, content = (batch.column(batch.schema.get_field_index(c)) for c in ("ext", "content"))
            sizes = [_header_size(c.as_buffer().to_pybytes() if c.is_valid else b"", e or "") for e, c in zip(ext.to_pylist(), content, strict=True)]
            dims = [pa.array([s and s[k] for s in sizes], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *dims], names=[*batch.schema.names, "width", "height"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(work, f"{fields}, width int, height int")


def _header_size(data: bytes, ext: str) -> tuple[int, int] | None:
    try:
        return image_size(data, ext)
    except EOFError:
        return None


def png_dims(df: DataFrame) -> DataFrame:
    """df(content) with width and height from the PNG header, without decoding; null for other files."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return df.withColumns({"width": F.when(is_png, number(17)), "height": F.when(is_png, number(21))})


def non_mip(images: DataFrame) -> DataFrame:
    return images.filter(~paths.is_mip(F.col("stem")))
