"""Texts of an Arrow column as one byte buffer, for numpy work inside tasks.

Spark hands ``mapInArrow`` its strings as UTF-8 bytes with offsets. The helpers here work on those
bytes directly, so that no Python string is made per row. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer document is a piece of its own.
PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random 64-bit value for each byte; the seed makes every task use the same ones.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    return _grown("up", _BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    return _grown("down", _INVERSE, n)


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * PIECE:
            _powers[name] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of at most ``limit`` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, never across documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after[first[first > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running polynomial sums, one longer than the data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data)), out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of the bytes that ``sums`` was made of; equal spans have equal hashes."""
    return mixed((sums[ends] - sums[starts]) * inverse_powers(len(sums))[starts])


def sequence_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * inverse_powers(len(sums))[: len(sums) - n])


def counts_in(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each document, as running bounds: bounds[i]:bounds[i + 1]."""
    return np.searchsorted(positions, offsets, "left")


def words_of_bytes(text: bytes, is_word: np.ndarray) -> list[bytes]:
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data, np.array([0, len(data)]), is_word)
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
