"""Images from bytes: sizes from headers of all formats, and pixels of PNG, BMP and TGA in numpy.

Pixels are height x width x channels of 8 bits in the order that Spark's image source has: gray, BGR or
BGRA. A decoder is a function from bytes to such an array; it raises ValueError where bytes are no whole image. ``DECODERS`` is by
lower-case extension, and a table of one's own may add others to it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Mapping

import numpy as np

Decoder = Callable[[bytes], np.ndarray]

#: Pixels of an image at most: more is an error, not an allocation.
MOST_PIXELS = 1 << 28


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _size(width: int, height: int) -> tuple[int, int]:
    _need(0 < width and 0 < height and width * height <= MOST_PIXELS, f"a size of {width} x {height}")
    return width, height


# --- sizes from headers --------------------------------------------------------------------------------

#: JPEG markers of frames, with the size; and markers that have no length.
_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
_BARE = {0x01, *range(0xD0, 0xD9)}
#: TGA image types.
_TGA_TYPES = {1, 2, 3, 9, 10, 11}


def image_size(data: bytes, ext: str = "") -> tuple[int, int] | None:
    """(width, height) from the header, whatever the name says, but for TGA, which has no mark and needs its extension; None where there is none.

    Raises EOFError where the header goes on after the bytes that are given.
    """
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _positive(*_unpacked(">II", data, 16)) if data[12:16] == b"IHDR" or len(data) < 16 else None
    if data[:2] == b"\xff\xd8":
        return _jpeg_size(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp_size(data)
    if data[:2] == b"BM" and len(data) >= 18:
        head = _unpacked("<I", data, 14)[0]
        width, height = _unpacked("<HH", data, 18) if head == 12 else _unpacked("<ii", data, 18)
        return _positive(width, abs(height))
    if ext.lower() == ".tga":
        kind = _unpacked("<B", data, 2)[0]
        return _positive(*_unpacked("<HH", data, 12)) if kind in _TGA_TYPES else None
    return None


def _positive(width: int, height: int) -> tuple[int, int] | None:
    return (width, height) if width > 0 and height > 0 else None


def _unpacked(form: str, data: bytes, at: int) -> tuple:
    if at + struct.calcsize(form) > len(data):
        raise EOFError
    return struct.unpack_from(form, data, at)


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """From marker to marker up to the first frame."""
    at = 2
    while True:
        lead, marker = _unpacked("BB", data, at)
        if lead != 0xFF:
            return None
        if marker == 0xFF:  # filling
            at += 1
        elif marker in _BARE:
            at += 2
        elif marker in _FRAMES:
            height, width = _unpacked(">HH", data, at + 5)
            return _positive(width, height)
        elif marker in (0xD9, 0xDA):
            return None
        else:
            (length,) = _unpacked(">H", data, at + 2)
            if length < 2:
                return None
            at += 2 + length


def _webp_size(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8 ":
        if _unpacked("3s", data, 23)[0] != b"\x9d\x01\x2a":
            return None
        width, height = _unpacked("<HH", data, 26)
        return _positive(width & 0x3FFF, height & 0x3FFF)
    if kind == b"VP8L":
        mark, bits = _unpacked("<BI", data, 20)
        return _positive((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1) if mark == 0x2F else None
    if kind == b"VP8X":
        low, high = _unpacked("<IH", data, 24)
        return (low & 0xFFFFFF) + 1, (low >> 24 | high << 8) + 1
    if len(data) < 30:
        raise EOFError
    return None


# --- PNG -----------------------------------------------------------------------------------------------

#: Samples of a pixel by colour type, and the seven passes of interlaced images (first column, first row, steps).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png(data: bytes) -> np.ndarray:
    """All colour types, depths and filters, interlaced or not; 16-bit samples keep their high byte. Alpha is kept; gray with alpha becomes BGRA."""
    _need(data[:8] == b"\x89PNG\r\n\x1a\n", "no PNG")
    at, header, palette, clear, body = 8, None, None, None, []
    while at + 8 <= len(data):
        length, name = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + length]
        _need(len(part) == length, "a cut chunk")
        if name == b"IHDR":
            _need(length == 13, "a broken header")
            header = struct.unpack(">IIBBBBB", part)
        elif name == b"PLTE":
            palette = np.frombuffer(part[: length // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = part
        elif name == b"IDAT":
            body.append(part)
        elif name == b"IEND":
            break
        at += 12 + length
    _need(header is not None and header[3] in _SAMPLES and header[2] in (1, 2, 4, 8, 16) and header[6] in (0, 1), "a broken header")
    width, height, depth, kind, _, _, interlaced = header
    _size(width, height)
    _need(kind != 3 or palette is not None, "no palette")
    samples = _SAMPLES[kind]
    passes = _PASSES if interlaced else ((0, 0, 1, 1),)
    shapes = [(-(-(height - y) // v), -(-(width - x) // h)) if x < width and y < height else (0, 0) for x, y, h, v in passes]
    strides = [(columns * samples * depth + 7) // 8 for _, columns in shapes]
    whole = sum(rows * (1 + stride) for (rows, columns), stride in zip(shapes, strides, strict=True) if rows and columns)
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(body), whole + 1)  # no more than there can be
    except zlib.error as e:
        raise ValueError(str(e)) from None
    _need(len(raw) >= whole, "too few rows")
    out, at = np.zeros((height, width, samples), np.uint16 if depth == 16 else np.uint8), 0
    for (x, y, h, v), (rows, columns), stride in zip(passes, shapes, strides, strict=True):
        if rows and columns:
            lines = _unfiltered(np.frombuffer(raw, np.uint8, rows * (1 + stride), at).reshape(rows, 1 + stride), max(1, samples * depth // 8))
            at += rows * (1 + stride)
            out[y::v, x::h] = _samples(lines, columns * samples, depth).reshape(rows, columns, samples)
    return _png_pixels(out, kind, depth, palette, clear)


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters, ``step`` bytes a pixel."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    _need(bool((kinds <= 4).all()), "an unknown filter")
    if (kinds >= 3).any():
        return _by_diagonals(kinds, rows, step)
    above = np.zeros(rows.shape[1], np.uint8)
    for row, kind in zip(rows, kinds.tolist(), strict=True):
        if kind == 1:
            for c in range(step):
                np.cumsum(row[c::step], dtype=np.uint8, out=row[c::step])
        elif kind == 2:
            row += above
        above = row
    return rows


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """All five filters at once: the pixels of a diagonal need only those of the two before it.

    With a row and a column of zeros in front, the places of a diagonal are a slice with the row's length as its step.
    """
    height, width = rows.shape[0], rows.shape[1] // step
    line = width + 1
    flat = np.zeros(((height + 1) * line, step), np.int16)
    flat.reshape(height + 1, line, step)[1:, 1:] = rows.reshape(height, width, step)
    wide = np.broadcast_to(kinds[:, None], (height, step))
    for d in range(width + height - 1):
        y0, y1 = max(0, d - width + 1), min(height, d + 1)
        at = (y0 + 1) * line + d - y0 + 1
        end = at + (y1 - y0 - 1) * width + 1
        near = lambda back: flat[at - back : end - back : width]  # noqa: B023, E731
        left, up, corner, kind = near(1), near(line), near(line + 1), wide[y0:y1]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        flat[at:end:width] = (flat[at:end:width] + guess) & 255
    return flat.reshape(height + 1, line, step)[1:, 1:].astype(np.uint8).reshape(height, -1)


def _samples(lines: np.ndarray, n: int, depth: int) -> np.ndarray:
    """The first n samples of each row."""
    if depth == 8:
        return lines[:, :n]
    if depth == 16:
        return lines[:, 0 : 2 * n : 2].astype(np.uint16) << 8 | lines[:, 1 : 2 * n : 2]
    bits = np.unpackbits(lines, axis=1)[:, : n * depth].reshape(len(lines), n, depth)
    return (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)


def _png_pixels(x: np.ndarray, kind: int, depth: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    if kind == 3:
        index = x[:, :, 0]
        _need(int(index.max()) < len(palette), "a colour that the palette lacks")
        colour = palette[index][:, :, ::-1]
        if clear is None:
            return colour
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear[: len(palette)], np.uint8)
        return np.concatenate([colour, alpha[index][:, :, None]], 2)
    alpha = None
    if clear is not None and kind in (0, 2) and len(clear) >= 2 * x.shape[2]:
        alpha = np.where((x == np.frombuffer(clear[: 2 * x.shape[2]], ">u2")).all(2), 0, 255).astype(np.uint8)[:, :, None]
    x = (x >> 8).astype(np.uint8) if depth == 16 else x * np.uint8({1: 255, 2: 85, 4: 17, 8: 1}[depth])
    if kind == 0:
        return x if alpha is None else np.concatenate([x, x, x, alpha], 2)
    if kind == 2:
        return x[:, :, ::-1] if alpha is None else np.concatenate([x[:, :, ::-1], alpha], 2)
    return np.concatenate([x[:, :, :1]] * 3 + [x[:, :, 1:]], 2) if kind == 4 else x[:, :, [2, 1, 0, 3]]


# --- BMP -----------------------------------------------------------------------------------------------


def bmp(data: bytes) -> np.ndarray:
    """1, 4 and 8 bits with a palette, plain or run-length for 4 and 8; 16, 24 and 32 bits, with masks. Only masks with alpha give BGRA."""
    try:
        return _bmp(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"a cut bitmap: {e}") from None


def _bmp(data: bytes) -> np.ndarray:
    _need(data[:2] == b"BM", "no bitmap")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
        packing, colours = 0, 0
    else:
        _need(head >= 40, "a broken header")
        width, height, _, depth, packing, _, _, _, colours = struct.unpack_from("<iiHHIIiiI", data, 18)
    down, height = height < 0, abs(height)
    _size(width, height)
    _need(depth in (1, 4, 8, 16, 24, 32), "an unknown depth")
    if depth <= 8:
        entry = 3 if head == 12 else 4
        many = min(colours or 1 << depth, 1 << depth)
        table = np.frombuffer(data, np.uint8, many * entry, 14 + head).reshape(many, entry)[:, :3]
        if packing in (1, 2):
            index = _bmp_runs(data, start, width, height, 4 if packing == 2 else 8)
        else:
            stride = (width * depth + 31) // 32 * 4
            index = _samples(np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride), width, depth)
        _need(int(index.max()) < many, "a colour that the palette lacks")
        out = table[index]
    elif depth == 24:
        stride = (width * 3 + 3) // 4 * 4
        out = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)[:, : width * 3].reshape(height, width, 3)
    else:
        out = _bmp_masked(data, start, width, height, depth, head, packing)
    return out if down else out[::-1]


def _bmp_masked(data: bytes, start: int, width: int, height: int, depth: int, head: int, packing: int) -> np.ndarray:
    stride = (width * depth + 31) // 32 * 4
    values = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)[:, : width * depth // 8].copy().view(f"<u{depth // 8}").astype(np.uint32)
    if packing in (3, 6):
        masks = list(struct.unpack_from("<III", data, 54)) + [struct.unpack_from("<I", data, 66)[0] if head >= 56 or packing == 6 else 0]
    else:
        masks = [0x7C00, 0x3E0, 0x1F, 0] if depth == 16 else [0xFF0000, 0xFF00, 0xFF, 0]
    red, green, blue, alpha = (_channel(values, m) for m in masks)
    return np.stack([blue, green, red] + ([alpha] if masks[3] else []), 2)


def _channel(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask, spread over 8 bits."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((((values & np.uint32(mask)) >> np.uint32(low)).astype(np.uint64) * np.uint64(255) + np.uint64(most // 2)) // np.uint64(most)).astype(np.uint8)


def _bmp_runs(data: bytes, at: int, width: int, height: int, depth: int) -> np.ndarray:
    """Palette indexes of run-length rows, lowest first; what is skipped is 0."""
    out, x, y = np.zeros((height, width), np.uint8), 0, 0
    while True:
        count, value = data[at], data[at + 1]
        at += 2
        if count or value > 2:
            many = count or value
            if count:
                pixels = np.full(many, value, np.uint8) if depth == 8 else np.tile(np.array([value >> 4, value & 15], np.uint8), (many + 1) // 2)[:many]
            else:
                size = many if depth == 8 else (many + 1) // 2
                raw = np.frombuffer(data, np.uint8, size, at)
                pixels = raw if depth == 8 else np.stack([raw >> 4, raw & 15], 1).ravel()[:many]
                at += size + size % 2
            if y < height:
                out[y, x : x + many] = pixels[: max(0, width - x)]
            x += many
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            return out
        else:
            x, y, at = x + data[at], y + data[at + 1], at + 2


# --- TGA -----------------------------------------------------------------------------------------------


def tga(data: bytes) -> np.ndarray:
    """Palette, true colour and gray, raw or run-length, from any corner; alpha where the header says that there is."""
    _need(len(data) >= 18, "no TGA")
    named, mapped, kind, first, many, entry, _, _, width, height, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    _need(kind in _TGA_TYPES and mapped in (0, 1), "no TGA")
    _size(width, height)
    base, at = kind & 7, 18 + named
    table = None
    if mapped:
        size = (entry + 7) // 8
        table, at = data[at : at + many * size], at + many * size
    step = (depth + 7) // 8
    _need((depth in (8, 16)) if base in (1, 3) else depth in (15, 16, 24, 32), "an unknown depth")
    raw = _tga_runs(data, at, width * height, step) if kind >= 9 else data[at : at + width * height * step]
    _need(len(raw) == width * height * step, "too few pixels")
    cells = np.frombuffer(raw, np.uint8).reshape(height * width, step)
    alpha = bool(flags & 15)
    if base == 1:
        _need(table is not None and entry in (15, 16, 24, 32), "no palette")
        colours = _tga_colours(np.frombuffer(table, np.uint8).reshape(many, -1), entry, alpha)
        index = cells.astype(np.int64) @ (256 ** np.arange(step)) - first
        _need(bool(((index >= 0) & (index < many)).all()), "a colour that the palette lacks")
        out = colours[index]
    elif base == 2:
        out = _tga_colours(cells, depth, alpha)
    else:
        out = cells[:, :1] if step == 1 else cells[:, [0, 0, 0, 1]]
    out = out.reshape(height, width, -1)
    out = out if flags & 32 else out[::-1]
    return out[:, ::-1] if flags & 16 else out


def _tga_colours(cells: np.ndarray, depth: int, alpha: bool) -> np.ndarray:
    if depth >= 24:
        return cells if depth == 32 and alpha else cells[:, :3]
    value = cells[:, 0].astype(np.uint32) | cells[:, 1].astype(np.uint32) << np.uint32(8)
    return np.stack([_channel(value, m) for m in (0x1F, 0x3E0, 0x7C00)], 1)


def _tga_runs(data: bytes, at: int, pixels: int, step: int) -> bytes:
    out, left = [], pixels
    while left > 0:
        _need(at < len(data), "too few pixels")
        many = min((data[at] & 127) + 1, left)
        if data[at] & 128:
            out.append(data[at + 1 : at + 1 + step] * many)
            at += 1 + step
        else:
            out.append(data[at + 1 : at + 1 + many * step])
            at += 1 + many * step
        left -= many
    return b"".join(out)


#: Decoders by extension.
DECODERS: Mapping[str, Decoder] = {".png": png, ".bmp": bmp, ".tga": tga}
