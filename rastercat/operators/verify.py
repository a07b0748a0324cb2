"""Pixel differences of matches where one image has many: its raster moves once for a slice of its matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastercat.functions import imaging
from rastercat.operators import similarity
from rastercat.sources.scratch import stored

#: Matches of one high that a task compares at once, about.
SLICE = 64
_PIXELS = ("width", "height", "channels", "data")


def sliced(matches: DataFrame, most: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(matches with __slice, a row (high_path, __slice) for each slice): a high's matches are dealt to as many slices as their number needs."""
    slices = F.greatest(F.lit(1), F.ceil(F.count("*") / most)).cast("int")
    # Stored, so that a high with very many matches is a plain join's large key, which adaptive execution can split.
    sizes = stored(matches.groupBy("high_path").agg(slices.alias("__slices")), "slices")
    dealt = matches.join(sizes, "high_path").withColumn("__slice", F.pmod(F.xxhash64("low_path"), F.col("__slices")).cast("int"))
    return dealt.drop("__slices"), sizes.select("high_path", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)).alias("__slice"))


def measured(matches: DataFrame, images: DataFrame, most: int = SLICE) -> DataFrame:
    """matches(low_path, high_path, more) with diff; pairs with an unreadable side drop out.

    The rasters of a slice's lows meet the one of its high in a task, which fits each low to the high's size. Pixels
    that are moved grow with the lows and the slices, and no task holds more than a slice.
    """
    columns = [c for c in matches.columns if c != "diff"]
    needed = similarity.semi_filter_pixels(images, matches)
    side = lambda s: needed.select(F.col("rel_path").alias(f"{s}_path"), *(F.col(c).alias(f"__{c}") for c in _PIXELS))
    dealt, slices = sliced(matches.select(*columns), most)
    lows, highs = dealt.join(side("low"), "low_path"), slices.join(side("high"), "high_path")
    lows = lows.select(*columns, "__slice", *(f"__{c}" for c in _PIXELS))

    def compared(low: pa.Table, high: pa.Table) -> pa.Table:
        schema = pa.schema([*(low.schema.field(c) for c in columns), pa.field("diff", pa.float64())])
        if not low.num_rows or not high.num_rows:
            return schema.empty_table()
        (target,) = _images(high.slice(0, 1))
        diffs = [imaging.mean_abs_diff(image, target) for image in _images(low)]
        return pa.Table.from_arrays([*(low.column(c) for c in columns), pa.chunked_array([pa.array(diffs, pa.float64())])], schema=schema)

    fields = ", ".join(f"`{c}` {lows.schema[c].dataType.simpleString()}" for c in columns)
    by = ("high_path", "__slice")
    return lows.groupBy(*by).cogroup(highs.groupBy(*by)).applyInArrow(compared, f"{fields}, diff double")


def _images(rows: pa.Table) -> list[np.ndarray]:
    """Rasters as RGB."""
    shapes = zip(*(rows.column(f"__{c}").to_pylist() for c in ("height", "width", "channels")), strict=True)
    return [imaging.rgb(np.frombuffer(x.as_buffer(), np.uint8).reshape(shape)) for x, shape in zip(rows.column("__data"), shapes, strict=True)]
