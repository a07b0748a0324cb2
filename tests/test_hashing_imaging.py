"""Hashes and pixels: hand-worked cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rastercat.functions import hashing, imaging


def test_constant_image_hashes_to_all_ones(spark):
    assert imaging.average_hash(np.full((5, 9), 17, np.uint8), 8) == [0xFFFFFFFF, 0xFFFFFFFF]
    df = spark.createDataFrame([([7] * 64,)], "px array<bigint>")
    assert df.select(hashing.average_hash(F.col("px"))).first()[0] == [0xFFFFFFFF, 0xFFFFFFFF]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=25, max_size=25))
def test_odd_sizes_pack_low_bits_first(px):
    words = imaging.average_hash(np.array(px, np.uint8).reshape(5, 5), 5)
    bits = sum(1 << i for i, p in enumerate(px) if p * 25 >= sum(px))
    assert words == [bits]


def test_array_hash_equals_pixel_hash(spark):
    rng = np.random.default_rng(1)
    planes = rng.integers(0, 256, (20, 256))
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(planes)], "k int, px array<bigint>")
    got = dict(df.select("k", hashing.average_hash(F.col("px"), 16)).collect())
    for k, p in enumerate(planes):
        assert got[k] == imaging.average_hash(p.reshape(16, 16).astype(np.uint8), 16)


def test_hex_round_trip_and_bad_hex(spark):
    df = spark.createDataFrame([([0, 0],), ([1, 0],), ([5, 0xFFFFFFFF],)], "w array<bigint>")
    hexed = df.withColumn("h", hashing.hash_to_hex(F.col("w")))
    assert [r["h"] for r in hexed.collect()] == ["0", "1", "ffffffff00000005"]
    assert hexed.filter(hashing.hash_from_hex(F.col("h")) != F.col("w")).count() == 0
    bad = spark.createDataFrame([("xyz",), ("",), ("1" * 17,), ("0x1f",)], "h string").select(hashing.hash_from_hex(F.col("h")))
    assert [r[0] for r in bad.collect()] == [None, None, None, [31, 0]]


def test_hamming_is_symmetric_and_zero_on_itself(spark):
    df = spark.createDataFrame([([1, 2], [3, 0])], "a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    assert tuple(df.select(hashing.hamming(a, b), hashing.hamming(b, a), hashing.hamming(a, a)).first()) == (2, 2, 0)


def test_sizes_are_checked():
    for bad in (3, 17):
        with pytest.raises(ValueError):
            hashing.check_hash_size(bad)
    with pytest.raises(ValueError):
        hashing.check_threshold(65, 8)
    hashing.check_threshold(64, 8)


def test_gray_drops_alpha():
    image = np.array([[[10, 20, 30, 0]]], np.uint8)  # B, G, R, A
    assert imaging.gray(image)[0, 0] == (19595 * 30 + 38470 * 20 + 7471 * 10 + 32768) >> 16
    assert imaging.gray(np.array([[[9]]], np.uint8))[0, 0] == 9


def test_resampling_keeps_constants_and_equal_sizes():
    flat = np.full((7, 5), 200, np.uint8)
    for kind in ("lanczos", "bicubic", "nearest"):
        assert (imaging.resized(flat, 13, 3, kind) == 200).all()
    noise = np.random.default_rng(2).integers(0, 256, (6, 6)).astype(np.uint8)
    assert (imaging.resized(noise, 6, 6, "lanczos") == noise).all()


def test_nearest_doubles_pixels():
    image = np.array([[1, 2], [3, 4]], np.uint8)
    assert imaging.resized(image, 4, 4, "nearest").tolist() == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]


def test_difference_heatmap_and_panels():
    low, high = np.zeros((2, 2, 3), np.uint8), np.zeros((2, 2, 3), np.uint8)
    high[0, 0] = (30, 3, 0)
    assert imaging.mean_abs_diff(low, high) == 33 / 12
    assert imaging.heatmap(low, high)[0, 0].tolist() == [11, 0, 0]
    raster = imaging.panels(low, high)
    assert raster.shape == (2 + 16, 3 * 2 + 32, 3)
    assert raster[8, 8 + 2 + 8].tolist() == [30, 3, 0] and raster[0, 0].tolist() == [30, 30, 30]


def test_upscaled_rows_keep_path_and_time(spark):
    schema = "rel_path string, mtime_ns bigint, width int, height int, channels int, data binary"
    df = spark.createDataFrame([("a.png", 5, 2, 1, 1, bytearray([7, 7]))], schema)
    row = imaging.upscale_batch(df).first()
    assert (row["rel_path"], row["mtime_ns"], row["width"], row["height"], bytes(row["data"])) == ("a.png", 5, 8, 4, bytes([7] * 32))
