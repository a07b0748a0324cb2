"""Decoders and header sizes against encoders written here, and against Spark's image source."""

import random
import struct
import time
import zlib

import numpy as np
import pytest

from rastercat.functions import decoders
from rastercat.functions.decoders import image_size

_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def filtered(row, above, kind, step):
    out = bytearray([kind])
    for k, x in enumerate(row):
        a, b, c = row[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
        p = a + b - c
        guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
        out.append((x - guess) & 255)
    return bytes(out)


def packed(values, depth):
    """A row's samples as bytes."""
    if depth == 16:
        return b"".join(struct.pack(">H", v) for v in values)
    bits = "".join(format(v, f"0{depth}b") for v in values)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def make_png(samples, kind, depth, interlaced=False, filters=(0, 1, 2, 3, 4), more=b""):
    """samples: height x width x channels."""
    height, width, n = samples.shape
    step, raw, number = max(1, n * depth // 8), b"", 0
    for x, y, h, v in _PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y::v, x::h]
        if not part.size:
            continue
        above = bytes(len(packed(part[0].ravel().tolist(), depth)))
        for line in part:
            row = packed(line.ravel().tolist(), depth)
            raw += filtered(row, above, filters[number % len(filters)], step)
            above, number = row, number + 1
    body = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, int(interlaced))) + more + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
KINDS = [(0, d) for d in (1, 2, 4, 8, 16)] + [(3, d) for d in (1, 2, 4, 8)] + [(k, d) for k in (2, 4, 6) for d in (8, 16)]


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kind, depth", KINDS)
def test_png_of_every_kind(kind, depth, interlaced):
    rng = np.random.default_rng(kind * 100 + depth)
    for height, width in ((1, 1), (5, 3), (9, 17), (2, 40)):
        x = rng.integers(0, 1 << depth, (height, width, SAMPLES[kind]))
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        data = make_png(x, kind, depth, interlaced, more=chunk(b"PLTE", palette.tobytes()) if kind == 3 else b"")
        got = decoders.png(data)
        eight = (x >> 8 if depth == 16 else x * 255 // ((1 << depth) - 1)).astype(np.uint8)
        want = palette[x[:, :, 0]][:, :, ::-1] if kind == 3 else eight[:, :, {0: [0], 2: [2, 1, 0], 4: [0, 0, 0, 1], 6: [2, 1, 0, 3]}[kind]]
        assert got.dtype == np.uint8 and (got == want).all() and image_size(data) == (width, height)


@pytest.mark.parametrize("filter_", range(5))
def test_png_filters(filter_):
    x = np.random.default_rng(filter_).integers(0, 256, (20, 31, 3))
    assert (decoders.png(make_png(x, 2, 8, filters=(filter_,))) == x[:, :, ::-1]).all()


def test_png_transparency():
    x = np.array([[[1], [2]], [[3], [1]]])
    assert decoders.png(make_png(x, 0, 8, more=chunk(b"tRNS", b"\0\1")))[:, :, 3].tolist() == [[0, 255], [255, 0]]
    more = chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\7\x09")
    got = decoders.png(make_png(x, 3, 8, more=more))
    assert got[0, 0].tolist() == [5, 4, 3, 9] and got[0, 1].tolist() == [8, 7, 6, 255]


def test_a_large_png_takes_no_seconds():
    """A megapixel with the filters that go from pixel to pixel."""
    x = np.zeros((1000, 1000, 3), np.uint8)
    raw = b"".join(bytes([4]) + bytes(3000) for _ in range(1000))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1000, 1000, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    began = time.process_time()
    assert (decoders.png(data) == x).all() and time.process_time() - began < 5


def test_broken_pngs_raise():
    good = make_png(np.arange(12).reshape(2, 2, 3), 2, 8)
    head = good[:33]
    for bad in (b"", b"junk", good[:20], good[:40], head + chunk(b"IDAT", b"nothing"), head + chunk(b"IDAT", zlib.compress(b"\0")), good.replace(b"\x08\x02\0\0\0", b"\x08\x05\0\0\0"), head[:16] + struct.pack(">II", 1 << 30, 1 << 30) + good[24:]):
        with pytest.raises(ValueError):
            decoders.png(bad)


def make_bmp(rows, depth, palette=b"", packing=0, down=False, width=None, height=None, head=40, masks=b""):
    body = rows if isinstance(rows, bytes) else b"".join(r + bytes(-len(r) % 4) for r in (rows if down else rows[::-1]))
    info = struct.pack("<IiiHHIIiiII", head, width, -height if down else height, 1, depth, packing, len(body), 0, 0, 0, 0) + masks + palette
    return b"BM" + struct.pack("<IHHI", 14 + len(info) + len(body), 0, 0, 14 + len(info)) + info + body


@pytest.mark.parametrize("down", [False, True])
def test_bmp_of_plain_depths(down):
    rng = np.random.default_rng(5)
    for width, height in ((1, 1), (5, 3), (9, 4)):
        shape = dict(width=width, height=height, down=down)
        x = rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
        assert (decoders.bmp(make_bmp([r[:, :3].tobytes() for r in x], 24, **shape)) == x[:, :, :3]).all()
        assert (decoders.bmp(make_bmp([r.tobytes() for r in x], 32, **shape)) == x[:, :, :3]).all()
        masks = struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000)
        assert (decoders.bmp(make_bmp([r.tobytes() for r in x], 32, packing=3, head=56, masks=masks, **shape)) == x).all()
        for depth in (1, 4, 8):
            palette = rng.integers(0, 256, (1 << depth, 4)).astype(np.uint8)
            index = rng.integers(0, 1 << depth, (height, width))
            data = make_bmp([packed(r.tolist(), depth) for r in index], depth, palette.tobytes(), **shape)
            assert (decoders.bmp(data) == palette[index][:, :, :3]).all() and image_size(data) == (width, height)


def test_bmp_of_16_bits_and_runs():
    values = np.array([[0x7FFF, 0x7C00], [0x03E0, 0x001F]], "<u2")
    got = decoders.bmp(make_bmp([r.tobytes() for r in values], 16, width=2, height=2))
    assert got.tolist() == [[[255, 255, 255], [0, 0, 255]], [[0, 255, 0], [255, 0, 0]]]
    palette = bytes(b for k in range(256) for b in (k, k, k, 0))
    runs = bytes([3, 7, 0, 3, 1, 2, 3, 0, 0, 0, 2, 9, 0, 2, 1, 0, 1, 5, 0, 1])
    assert decoders.bmp(make_bmp(runs, 8, palette, packing=1, width=6, height=2))[:, :, 0].tolist() == [[9, 9, 0, 5, 0, 0], [7, 7, 7, 1, 2, 3]]
    half = bytes([5, 0x12, 0, 0, 0, 3, 0x34, 0x50, 0, 1])
    assert decoders.bmp(make_bmp(half, 4, palette[:64], packing=2, width=5, height=2))[:, :, 0].tolist() == [[3, 4, 5, 0, 0], [1, 2, 1, 2, 1]]
    for bad in (b"BM", make_bmp(runs[:5], 8, palette, packing=1, width=6, height=2), make_bmp([b"\0\0\0"], 24, width=4, height=4)):
        with pytest.raises(ValueError):
            decoders.bmp(bad)


def make_tga(pixels, width, height, depth, kind, flags=0x20, palette=b"", many=0, entry=0, name=b"abc"):
    return struct.pack("<BBBHHBHHHHBB", len(name), int(bool(palette)), kind, 0, many, entry, 0, 0, width, height, depth, flags) + name + palette + pixels


def runs_of(cells):
    """TGA packets, of equal cells or raw ones, at random lengths."""
    rng, out, k = random.Random(len(cells)), b"", 0
    while k < len(cells):
        n = 1
        while k + n < len(cells) and cells[k + n] == cells[k] and n < 128:
            n += 1
        if n > 1:
            out += bytes([127 + n]) + cells[k]
        else:
            n = min(rng.randrange(1, 6), len(cells) - k)
            out += bytes([n - 1]) + b"".join(cells[k : k + n])
        k += n
    return out


@pytest.mark.parametrize("flags", [0x00, 0x10, 0x20, 0x30])
@pytest.mark.parametrize("run", [False, True])
def test_tga_of_every_kind(flags, run):
    rng = np.random.default_rng(flags)
    for height, width in ((1, 1), (4, 7), (3, 200)):
        turned = lambda a: (a if flags & 0x20 else a[::-1])[:, :: -1 if flags & 0x10 else 1]  # noqa: B023, E731
        x = rng.integers(0, 3, (height, width, 4)).astype(np.uint8)
        for depth, alpha in ((24, 0), (32, 8), (32, 0)):
            cells = [bytes(p) for p in x[:, :, : depth // 8].reshape(-1, depth // 8)]
            data = make_tga(runs_of(cells) if run else b"".join(cells), width, height, depth, 10 if run else 2, flags | alpha)
            assert (decoders.tga(data) == turned(x[:, :, : 4 if alpha else 3])).all()
            assert image_size(data, ".TGA") == (width, height)
        cells = [bytes([p]) for p in x[:, :, 0].ravel()]
        pixels = runs_of(cells) if run else b"".join(cells)
        assert (decoders.tga(make_tga(pixels, width, height, 8, 11 if run else 3, flags))[:, :, 0] == turned(x[:, :, :1])[:, :, 0]).all()
        palette = rng.integers(0, 256, (3, 3)).astype(np.uint8)
        got = decoders.tga(make_tga(pixels, width, height, 8, 9 if run else 1, flags, palette.tobytes(), 3, 24))
        assert (got == turned(palette[x[:, :, 0]])).all()


def test_broken_tgas_raise():
    good = make_tga(bytes(12), 2, 2, 24, 2)
    for bad in (b"", good[:17], good[:-1], make_tga(b"\x83\1\2\3", 5, 5, 24, 10), make_tga(bytes(4), 2, 2, 8, 1, palette=bytes(3), many=1, entry=9), make_tga(b"\5" * 4, 2, 2, 8, 1, palette=bytes(3), many=1, entry=24)):
        with pytest.raises(ValueError):
            decoders.tga(bad)


def jpeg(width, height, parts=(), frame=0xC0):
    out = b"\xff\xd8"
    for marker, size in parts:
        out += bytes([0xFF, 0xFF, marker]) + struct.pack(">H", size + 2) + b"\xff" * size
    return out + bytes([0xFF, frame]) + struct.pack(">HBHHB", 17, 8, height, width, 3) + bytes(9)


def test_sizes_of_jpeg_and_webp():
    for frame in (0xC0, 0xC2):
        data = jpeg(640, 480, [(0xE0, 14), (0xE1, 65000), (0xE2, 65000), (0xDB, 65)], frame)
        assert image_size(data) == (640, 480)
        with pytest.raises(EOFError):
            image_size(data[:70000])
    assert image_size(b"\xff\xd8\xff\xda\0\2") is None and image_size(b"\xff\xd8junk") is None
    riff = lambda kind, body: b"RIFF\0\0\0\0WEBP" + kind + struct.pack("<I", len(body)) + body
    assert image_size(riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 0x4000 | 200))) == (300, 200)
    assert image_size(riff(b"VP8L", b"\x2f" + struct.pack("<I", (299) | (199 << 14)))) == (300, 200)
    assert image_size(riff(b"VP8X", bytes(4) + struct.pack("<I", 69_999)[:3] + struct.pack("<I", 4)[:3])) == (70_000, 5)
    assert image_size(b"") is None and image_size(b"whatever", ".png") is None and image_size(b"BM" + bytes(12)) is None
    with pytest.raises(EOFError):
        image_size(b"\x89PNG\r\n\x1a\n")
