"""Resampling as relations: pixels joined with a table of coefficients and summed, once along rows and once along columns.

The scheme is that of ``imaging.resized``: separable, horizontal first, 22-bit fixed-point weights, and results of 8 bits after each pass.
A pass is a sparse matrix product: every pixel meets the places that it counts for, and sums are begun where
the image's pixels are, so what is dealt is not larger than the result. Images of all sizes go together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastercat.functions.imaging import PRECISION

#: Places to each side of the centre that a filter reaches, in source pixels where it doesn't shrink.
REACH = {"lanczos": 3.0, "bicubic": 2.0}


def _kernel(x: Column, kind: str) -> Column:
    x = F.abs(x)
    if kind == "bicubic":
        near, far = ((1.5 * x - 2.5) * x) * x + 1.0, (((x - 5.0) * x + 8.0) * x - 4.0) * -0.5
        return F.when(x < 1.0, near).when(x < 2.0, far).otherwise(0.0)
    wave = lambda v: F.when(v == 0.0, F.lit(1.0)).otherwise(F.sin(F.pi() * v) / (F.pi() * v))
    return F.when(x < 3.0, wave(x) * wave(x / 3.0)).otherwise(0.0)


def coefficients(sizes: DataFrame, to: int, kind: str) -> DataFrame:
    """(size, x, i, weight) for sizes(size): how much the pixel x of a line of that size counts for the pixel i of one of ``to``."""
    scale = F.col("size") / F.lit(float(to))
    stretch = F.greatest(scale, F.lit(1.0))
    centre = (F.col("i") + 0.5) * scale
    whole = lambda c: c.cast("int")  # towards zero
    first = F.greatest(F.lit(0), whole(centre - REACH[kind] * stretch + 0.5))
    last = F.least(F.col("size"), whole(centre + REACH[kind] * stretch + 0.5))
    rows = sizes.select(F.col("size").cast("int").alias("size")).distinct().select("size", F.explode(F.sequence(F.lit(0), F.lit(to - 1))).alias("i"))
    rows = rows.select("size", "i", F.explode(F.sequence(first, last - 1)).alias("x"))
    raw = rows.withColumn("raw", _kernel((F.col("x") - centre + 0.5) / stretch, kind))
    part = F.col("raw") / F.sum("raw").over(Window.partitionBy("size", "i").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fixed = part * float(1 << PRECISION)
    return raw.select("size", "x", "i", F.when(fixed < 0, fixed - 0.5).otherwise(fixed + 0.5).cast("bigint").alias("weight"))


def _pass(pixels: DataFrame, line: str, place: str, to: int, kind: str, keys: list[str]) -> DataFrame:
    """pixels with one direction resampled: place goes over ``to`` pixels; lines that have that size stay."""
    table = coefficients(pixels.filter(F.col(line) != to).select(F.col(line).alias("size")), to, kind)
    other = [c for c in keys if c not in (line, place)]
    met = pixels.filter(F.col(line) != to).join(table.withColumnsRenamed({"size": line, "x": place}), [line, place])
    total = F.shiftright(F.sum(F.col("v") * F.col("weight")) + (1 << (PRECISION - 1)), PRECISION)
    made = met.groupBy(*other, "i").agg(F.greatest(F.lit(0), F.least(F.lit(255), total)).cast("int").alias("v"))
    made = made.select(*other, F.col("i").alias(place), F.lit(to).alias(line), "v")
    return made.unionByName(pixels.filter(F.col(line) == to).select(*made.columns))


def resized(pixels: DataFrame, width: int, height: int, kind: str, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """pixels(*by, width, height, y, x, v) in another size: a row for each pixel of an image, or of a channel where ``by`` names one."""
    keys = [*by, "width", "height", "y", "x"]
    wide = _pass(pixels.select(*keys, F.col("v").cast("int").alias("v")), "width", "x", width, kind, keys)
    return _pass(wide, "height", "y", height, kind, keys).select(*keys, "v")


def pixels_of(planes: DataFrame, columns: dict[str, Column], width: Column, height: Column, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """(*by, channel, width, height, y, x, v) of arrays of pixels, row by row, one column for each channel."""
    parts = [planes.select(*by, F.lit(name).alias("channel"), width.cast("int").alias("width"), height.cast("int").alias("height"), F.posexplode(pixels).alias("at", "v")) for name, pixels in columns.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(*by, "channel", "width", "height", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).alias("x"), "v")


def plane(pixels: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """(*by, pixels): the values row by row, for images that are small enough for an array."""
    listed = pixels.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return listed.select(*by, F.transform("p", lambda p: p["v"]).alias("pixels"))
