"""Resampling as relations against the one in numpy, image by image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastercat.functions import imaging, resample

SIZES = [(1, 1), (3, 8), (8, 8), (16, 5), (33, 2), (7, 40)]


@pytest.mark.parametrize("kind", ["lanczos", "bicubic"])
@pytest.mark.parametrize("width, height", [(8, 8), (4, 4), (11, 6), (1, 1), (40, 3)])
def test_images_of_all_sizes_at_once(spark, kind, width, height):
    rng = np.random.default_rng(width)
    images = [rng.integers(0, 256, (h, w)).astype(np.uint8) for w, h in SIZES] + [np.full((9, 9), 255, np.uint8), np.zeros((9, 9), np.uint8)]
    rows = spark.createDataFrame([(i, x.shape[1], x.shape[0], x.ravel().tolist()) for i, x in enumerate(images)], "id int, w int, h int, px array<int>")
    pixels = resample.pixels_of(rows, {"gray": F.col("px")}, F.col("w"), F.col("h"))
    made = resample.resized(pixels, width, height, kind)
    assert made.columns == ["id", "width", "height", "y", "x", "v"]
    got = {r["id"]: r["pixels"] for r in resample.plane(made).collect()}
    for i, x in enumerate(images):
        assert got[i] == imaging.resized(x, width, height, kind).ravel().tolist()


@pytest.mark.parametrize("kind", ["lanczos", "bicubic"])
def test_coefficients_equal_the_matrix(spark, kind):
    sizes = [1, 2, 5, 8, 30, 100]
    rows = resample.coefficients(spark.createDataFrame([(s,) for s in [*sizes, 8]], "size int"), 9, kind).collect()
    for size in sizes:
        want = imaging._coefficients(size, 9, kind)
        got = np.zeros_like(want)
        for r in rows:
            if r["size"] == size:
                got[r["i"], r["x"]] = r["weight"]
        assert (got == want).all()


def test_no_images(spark):
    none = spark.createDataFrame([], "id int, width int, height int, y int, x int, v int")
    assert resample.resized(none, 4, 4, "lanczos").count() == 0
