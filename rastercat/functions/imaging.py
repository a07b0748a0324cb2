"""Pixels in numpy, one image at a time inside Arrow batches: gray, resampling, hashes, differences, panels.

Resampling is separable, horizontal first, with 22-bit fixed-point coefficients and 8-bit results
after each pass; a shrinking filter's support grows with the scale. Equal sizes are left unchanged.
It is written from the public description of that scheme and can't be compared with another
implementation in this environment.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 22
HEAT_BACKGROUND, PADDING = 30, 8


# --- arrays ------------------------------------------------------------------------------------------


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """height x width x channels of an image row, in the source's BGR(A) order."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def rgb(image: np.ndarray) -> np.ndarray:
    """Three channels in RGB order; alpha is dropped, gray is repeated."""
    return image[:, :, 2::-1] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, axis=2)


def gray(image: np.ndarray) -> np.ndarray:
    """8-bit luma in fixed point; one channel passes through."""
    if image.shape[2] < 3:
        return image[:, :, 0]
    red, green, blue = (rgb(image)[:, :, k].astype(np.int64) for k in range(3))
    return ((19595 * red + 38470 * green + 7471 * blue + 32768) >> 16).astype(np.uint8)


def _lanczos(x: float) -> float:
    return float(np.sinc(x) * np.sinc(x / 3)) if abs(x) < 3 else 0.0


def _bicubic(x: float, a: float = -0.5) -> float:
    x = abs(x)
    if x < 1:
        return ((a + 2) * x - (a + 3)) * x * x + 1
    return (((x - 5) * x + 8) * x - 4) * a if x < 2 else 0.0


@functools.lru_cache(256)
def _coefficients(size: int, to: int, kind: str) -> np.ndarray:
    """to x size matrix of fixed-point weights."""
    kernel, reach = (_lanczos, 3.0) if kind == "lanczos" else (_bicubic, 2.0)
    scale = size / to
    stretch = max(scale, 1.0)
    out = np.zeros((to, size), np.int64)
    for i in range(to):
        centre = (i + 0.5) * scale
        first = max(0, int(centre - reach * stretch + 0.5))
        last = min(size, int(centre + reach * stretch + 0.5))
        weights = np.array([kernel((j - centre + 0.5) / stretch) for j in range(first, last)])
        weights = weights / weights.sum()
        out[i, first:last] = np.trunc(weights * (1 << PRECISION) + np.where(weights < 0, -0.5, 0.5)).astype(np.int64)
    return out


def _pass(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    moved = np.moveaxis(image.astype(np.int64), axis, -1)
    total = (moved @ weights.T + (1 << (PRECISION - 1))) >> PRECISION
    return np.moveaxis(np.clip(total, 0, 255).astype(np.uint8), -1, axis)


def resized(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """A gray or RGB image in another size: 'lanczos', 'bicubic' or 'nearest'."""
    if kind == "nearest":
        rows = ((np.arange(height) + 0.5) * image.shape[0] / height).astype(np.int64)
        columns = ((np.arange(width) + 0.5) * image.shape[1] / width).astype(np.int64)
        return image[rows][:, columns]
    if image.shape[1] != width:
        image = _pass(image, _coefficients(image.shape[1], width, kind), 1)
    if image.shape[0] != height:
        image = _pass(image, _coefficients(image.shape[0], height, kind), 0)
    return image


def average_hash(plane: np.ndarray, hash_size: int) -> list[int]:
    """Words of the average hash of a gray image."""
    small = resized(plane, hash_size, hash_size, "lanczos").astype(np.int64).ravel()
    bits = np.packbits(small * small.size >= small.sum(), bitorder="little")
    bits = np.concatenate([bits, np.zeros(-len(bits) % 4, np.uint8)])
    return bits.view("<u4").astype(np.int64).tolist()


def mean_abs_diff(low: np.ndarray, high: np.ndarray) -> float:
    """Mean difference of two RGB images in the second one's size."""
    fitted = resized(low, high.shape[1], high.shape[0], "bicubic")
    return float(np.abs(fitted.astype(np.int64) - high).sum()) / high.size


def heatmap(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mean difference of each pixel, in the red channel."""
    fitted = resized(low, high.shape[1], high.shape[0], "bicubic")
    out = np.zeros_like(high)
    out[:, :, 0] = np.abs(fitted.astype(np.int64) - high).sum(2) // 3
    return out


def panels(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Low (nearest), high and heatmap side by side."""
    h, w = high.shape[:2]
    out = np.full((h + 2 * PADDING, 3 * w + 4 * PADDING, 3), HEAT_BACKGROUND, np.uint8)
    for k, part in enumerate((resized(low, w, h, "nearest"), high, heatmap(low, high))):
        left = PADDING + k * (w + PADDING)
        out[PADDING : PADDING + h, left : left + w] = part
    return out


# --- columns of equal-sized planes ---------------------------------------------------------------------


def gray_of_arrays(red: Column, green: Column, blue: Column) -> Column:
    """Luma of three arrays of channel values."""
    return F.transform(F.arrays_zip(red.alias("r"), green.alias("g"), blue.alias("b")), lambda x: F.shiftright(19595 * x["r"] + 38470 * x["g"] + 7471 * x["b"] + 32768, 16))


def mean_abs_diff_of_arrays(a: Column, b: Column) -> Column:
    """Mean difference of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(a)


def heatmap_of_arrays(a: Column, b: Column) -> Column:
    """Red values of the heatmap of two gray planes."""
    return F.zip_with(a, b, lambda x, y: F.floor(3 * F.abs(x - y) / 3).cast("bigint"))


# --- batches of image rows -----------------------------------------------------------------------------


def _image(row, prefix: str = "") -> np.ndarray:
    return pixels(row[f"{prefix}data"], row[f"{prefix}height"], row[f"{prefix}width"], row[f"{prefix}channels"])


def hash_images(images: DataFrame, hash_size: int = 8) -> DataFrame:
    """images(rel_path, width, height, channels, data, more) to the same without pixels, with hash_size and hash_words; null where there is no data."""
    kept = [f.name for f in images.schema if f.name not in ("data", "channels")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            shapes = zip(*(column[c].to_pylist() for c in ("height", "width", "channels")), strict=True)
            words = [average_hash(gray(np.frombuffer(x.as_buffer(), np.uint8).reshape(shape)), hash_size) if x.is_valid else None for x, shape in zip(column["data"], shapes, strict=True)]
            made = [pa.array([hash_size] * len(words), pa.int32()), pa.array(words, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), *made], names=[*kept, "hash_size", "hash_words"])

    fields = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept)
    return images.mapInArrow(work, f"{fields}, hash_size int, hash_words array<bigint>")


def _pair_batches(pairs: DataFrame, schema: str, made: Callable[[np.ndarray, np.ndarray], dict]) -> DataFrame:
    keys = [f for f in pairs.schema if not f.name.endswith(("data", "channels")) and f.name not in ("low_width", "low_height", "high_width", "high_height")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [made(rgb(_image(r, "low_")), rgb(_image(r, "high_"))) for r in batch.to_dict("records")]
            out = batch[[f.name for f in keys]].copy()
            for name in rows[0] if rows else ():
                out[name] = [r[name] for r in rows]
            if rows:
                yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return pairs.mapInPandas(work, f"{fields}, {schema}")


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(low_/high_ width, height, channels, data, more) with diff instead of the pixels."""
    return _pair_batches(pairs, "diff double", lambda low, high: {"diff": mean_abs_diff(low, high)})


def diff_heatmap(pairs: DataFrame) -> DataFrame:
    """The same with the heatmap as an RGB raster."""
    return _pair_batches(pairs, "heat_width int, heat_height int, heat binary", lambda low, high: {"heat_width": high.shape[1], "heat_height": high.shape[0], "heat": heatmap(low, high).tobytes()})


def visual_panels(pairs: DataFrame) -> DataFrame:
    """The same with the three panels as one RGB raster."""

    def made(low: np.ndarray, high: np.ndarray) -> dict:
        raster = panels(low, high)
        return {"panel_width": raster.shape[1], "panel_height": raster.shape[0], "panel": raster.tobytes()}

    return _pair_batches(pairs, "panel_width int, panel_height int, panel binary", made)


def bicubic_x4(image: np.ndarray) -> np.ndarray:
    """A stand-in for an upscaler: four times the size."""
    return resized(image, image.shape[1] * 4, image.shape[0] * 4, "bicubic")


def upscale_batch(staged: DataFrame, fn: Callable[[np.ndarray], np.ndarray] = bicubic_x4) -> DataFrame:
    """staged(rel_path, mtime_ns, width, height, channels, data, more) transformed; rel_path and the source's mtime stay."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [fn(_image(row)) for row in batch.to_dict("records")]
            yield batch.assign(width=[m.shape[1] for m in made], height=[m.shape[0] for m in made], channels=[m.shape[2] for m in made], data=[m.tobytes() for m in made])[list(batch.columns)]

    return staged.mapInPandas(work, staged.schema)
