"""Folders: listings, sizes from headers, decoders of one's own, and hashes that save decoding."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastercat.functions import decoders, imaging
from rastercat.jobs.consolidate import consolidate_folder, consolidate_variants
from rastercat.sources import catalog, listing
from tests.test_decoders import jpeg, make_bmp, make_tga


def png(x):
    """A gray image."""
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def pattern(seed, side):
    """The same picture in any size."""
    return np.kron(np.random.default_rng(seed).integers(0, 256, (8, 8)), np.ones((side // 8, side // 8))).astype(np.uint8)


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "tree"
    (root / "one/two/three").mkdir(parents=True)
    (root / "empty").mkdir()
    (root / ".hidden").mkdir()
    (root / "_also").mkdir()
    gray = lambda x: make_tga(x.tobytes(), x.shape[1], x.shape[0], 8, 3)
    rows = lambda x: [bytes(np.repeat(r, 3)) for r in x]
    files = {
        "s-1-a.png": png(pattern(1, 64)), "one/l-1-b.tga": gray(pattern(1, 256)), "one/two/three/l-1-c.BMP": make_bmp(rows(pattern(1, 512)), 24, width=512, height=512), "one/lonely-2-a.png": png(pattern(2, 64)),
        "one/s-3-x.TGA": gray(pattern(3, 32)), "one/l-3-y.png": png(pattern(4, 256)), "one/two/s-3-bad.png": png(pattern(3, 64))[:60], "one/t-mip1.png": png(pattern(3, 64)), "one/nodash.png": png(pattern(3, 64)),
        "one/s-3-none.png": b"junk", "one/note.txt": b"text", ".hidden/s-9-a.png": b"", "_also/s-9-b.png": b"", ".s-9-c.png": b"", "é ü/s-1-ö #%.png": png(pattern(1, 16)),
    }
    for name, data in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
        os.utime(root / name, ns=(10**18 + 123_456_789, 10**18 + 123_456_789))
    return str(root)


def test_listing_equals_the_scan(spark, folder):
    mine, scan = ({r["rel_path"]: r.asDict() for r in df.collect()} for df in (listing.list_files(spark, folder), catalog.scan_files(spark, folder)))
    assert set(mine) == set(scan) and len(mine) == 12
    for path, row in mine.items():
        assert row["mtime_ns"] == 10**18 + 123_456_789 and row["mtime_ns"] // 10**6 == scan[path]["mtime_ns"] // 10**6
        assert {c: row[c] for c in ("dir", "name", "stem", "ext", "size")} == {c: scan[path][c] for c in ("dir", "name", "stem", "ext", "size")}
    assert {r["rel_path"] for r in listing.list_catalog(spark, "file://" + folder).collect()} == {p for p in mine if not p.endswith("txt")}


def test_listing_of_nothing(spark, tmp_path):
    assert listing.list_files(spark, str(tmp_path)).count() == 0
    assert listing.list_files(spark, str(tmp_path / "missing")).count() == 0


def test_sizes_without_decoding(spark, folder):
    files = listing.list_catalog(spark, folder)
    by_path = {r["rel_path"]: (r["width"], r["height"]) for r in listing.with_dims(files, folder).collect()}
    assert by_path["one/l-1-b.tga"] == (256, 256) and by_path["one/two/three/l-1-c.BMP"] == (512, 512) and by_path["one/s-3-none.png"] == (None, None) and by_path["one/two/s-3-bad.png"] == (64, 64)
    by_content = {r["rel_path"]: (r["width"], r["height"]) for r in catalog.header_dims(catalog.scan_catalog(spark, folder, content=True)).drop("content").collect()}
    assert by_path == by_content
    gone = files.withColumn("rel_path", F.concat("rel_path", F.lit(".gone")))
    assert listing.with_dims(gone, folder).filter("width is not null").count() == 0
    assert {r["message"] for r in listing.with_contents(gone, folder).collect()} == {"can't be read: FileNotFoundError"}


def test_size_of_a_jpeg_with_a_long_header(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg(640, 480, [(0xE1, 65000)] * 3))
    assert [(r["width"], r["height"]) for r in listing.with_dims(listing.list_catalog(spark, str(tmp_path)), str(tmp_path)).collect()] == [(640, 480)]


def test_images_of_own_decoders(spark, folder, tmp_path):
    """Tga rows with times and sizes; a decoder for a format that has none; one that fails."""
    with open(os.path.join(folder, "x-1-w.webp"), "wb") as f:
        f.write(b"\x05\x06")

    def webp(data):
        return np.frombuffer(data, np.uint8).reshape(1, 2, 1)

    images, failed = catalog.read_images(spark, folder, {".webp": webp})
    got = {r["rel_path"]: r for r in images.collect()}
    assert (got["one/s-3-x.TGA"]["width"], got["one/s-3-x.TGA"]["channels"], got["one/s-3-x.TGA"]["mtime_ns"] // 10**6, got["one/s-3-x.TGA"]["size"]) == (32, 1, (10**18 + 123_456_789) // 10**6, os.path.getsize(folder + "/one/s-3-x.TGA"))
    assert bytes(got["x-1-w.webp"]["data"]) == b"\5\6" and bytes(got["one/s-3-x.TGA"]["data"]) == pattern(3, 32).tobytes()
    assert {r["rel_path"] for r in failed.collect()} == {"one/two/s-3-bad.png", "one/s-3-none.png"}
    images, failed = catalog.read_images(spark, folder)
    assert "x-1-w.webp" not in {r["rel_path"] for r in images.collect()} and "x-1-w.webp" in {r["rel_path"] for r in failed.collect()}


def test_own_png_equals_the_image_source(spark, folder):
    ours, _ = catalog.read_images(spark, folder)
    theirs = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder).select("image.*").collect()
    by_shape = sorted((r["height"], r["width"], r["nChannels"], bytes(r["data"])) for r in theirs if r["origin"].endswith("png"))
    mine = sorted((r["height"], r["width"], r["channels"], bytes(r["data"])) for r in ours.filter("lower(ext) = '.png'").collect())
    assert mine == by_shape


def counting(log):
    """The usual decoders, each of which notes that it was called."""

    def noted(decode):
        def one(data):
            with open(log, "a") as f:
                f.write("x")
            return decode(data)

        return one

    return {ext: noted(f) for ext, f in decoders.DECODERS.items()}


def test_consolidation_of_a_folder_decodes_misses_only(spark, folder, tmp_path):
    log = tmp_path / "log"
    calls = lambda: len(log.read_text()) if log.exists() else 0
    first = consolidate_folder(spark, folder, decoders=counting(log))
    plan = {r["dst_path"]: (r["src_path"], r["hamming"], r["replaced"]) for r in first.plan.collect()}
    assert plan["s-1-a.png"] == ("one/l-1-b.tga", 0, True) and plan["é ü/s-1-ö #%.png"] == ("one/l-1-b.tga", 0, True) and plan["one/s-3-x.TGA"][0] == "one/l-3-y.png" and len(plan) == 3
    assert {r["rel_path"]: r["message"] for r in first.failed.collect()} == {"one/two/s-3-bad.png": "can't be decoded: a cut chunk", "one/s-3-none.png": "no size in its header"}
    assert calls() == 7  # nothing of a group that lacks a side, and each other file once
    manifest = spark.createDataFrame(first.manifest.collect(), first.manifest.schema)
    again = consolidate_folder(spark, folder, manifest=manifest, decoders=counting(log))
    assert {r["dst_path"]: (r["src_path"], r["hamming"], r["replaced"]) for r in again.plan.collect()} == plan
    assert calls() == 8  # the broken file has no hash
    with open(os.path.join(folder, "s-1-a.png"), "wb") as f:
        f.write(png(pattern(5, 64)))
    third = consolidate_folder(spark, folder, manifest=manifest, decoders=counting(log))
    assert {r["rel_path"] for r in third.hashed.filter("not reused").collect()} == {"s-1-a.png"} and calls() == 10
    assert not {r["dst_path"]: r["replaced"] for r in third.plan.collect()}["s-1-a.png"]


def test_folder_and_decoded_images_give_one_plan(spark, folder):
    plan = lambda c: sorted((r["dst_path"], r["src_path"], r["hamming"], r["replaced"]) for r in c.plan.collect())
    images, _ = catalog.read_images(spark, folder)
    whole = consolidate_variants(images)
    assert plan(whole) == plan(consolidate_folder(spark, folder))
    manifest = spark.createDataFrame(whole.manifest.collect(), whole.manifest.schema)
    assert {r["reused"] for r in consolidate_variants(images, manifest=manifest).hashed.collect()} == {True}


def test_formats_that_spark_decodes(spark, tmp_path, monkeypatch):
    """A format without a decoder here, by name where there are few files and from the whole folder where there are more."""
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    for name, side in (("s-1-a.JPG", 64), ("sub/l-1-b.jpg", 256), ("sub/l-1-c.jpeg", 256)):
        (root / name).write_bytes(png(pattern(1, side)))  # Spark looks at the bytes, not at the name
    (root / "s-1-d.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0" + bytes(4) + b"\x3f\0\0\x3f\0\0")
    results = []
    for named in (catalog.NAMED, 1):
        monkeypatch.setattr(catalog, "NAMED", named)
        got = consolidate_folder(spark, str(root))
        assert [r["rel_path"] for r in got.failed.collect()] == ["s-1-d.webp"]
        results.append([(r["dst_path"], r["src_path"], r["hamming"]) for r in got.plan.collect()])
    assert results[0] == results[1] == [("s-1-a.JPG", "sub/l-1-b.jpg", 0)]


def test_hashes_of_rows_without_pixels(spark):
    rows = [("a", 8, 8, 1, bytearray(range(64))), ("b", None, None, None, None)]
    got = {r["rel_path"]: r["hash_words"] for r in imaging.hash_images(spark.createDataFrame(rows, "rel_path string, width int, height int, channels int, data binary")).collect()}
    assert got["b"] is None and got["a"] == [0, 0xFFFFFFFF]
