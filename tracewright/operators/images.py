"""Perceptual hashes of images from their bytes: a PNG reader and writer and a Lanczos resize over NumPy.

Non-interlaced PNG of at most 8 bits a sample is read; other payloads give null features (no image library
is assumed)."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
FIXED_BITS = 22


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def write_png(gray: np.ndarray) -> bytes:
    """An 8-bit greyscale image, losslessly."""
    high, wide = gray.shape
    rows = b"".join(b"\0" + row.tobytes() for row in gray.astype(np.uint8))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def _unfiltered(data: bytes, high: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((high, stride), np.uint8)
    above = bytearray(stride)
    for y in range(high):
        kind, row = data[y * (stride + 1)], bytearray(data[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        if kind == 2:
            row = bytearray((np.frombuffer(row, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif kind in (1, 3, 4):
            for i in range(stride):
                left, up, corner = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
                if kind == 4:
                    guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))  # noqa: B023  (ties: left, up, corner)
                else:
                    guess = left if kind == 1 else (left + up) // 2
                row[i] = (row[i] + guess) & 255
        elif kind:
            raise ValueError("filter type")
        out[y] = row
        above = row
    return out


def read_rgba(data: bytes) -> np.ndarray:
    """Red, green, blue and alpha of each pixel; a tRNS chunk gives the alpha of palettes and of one colour."""
    if data[:8] != SIGNATURE:
        raise ValueError("not PNG")
    at, packed, palette, clear, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = body
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + n
    wide, high, depth, colour, _, _, interlaced = head
    if depth > 8 or interlaced:
        raise ValueError("not read: 16-bit or interlaced")
    bits = depth * CHANNELS[colour]
    raw = _unfiltered(zlib.decompress(b"".join(packed)), high, (wide * bits + 7) // 8, max(bits // 8, 1))
    if depth < 8:
        spread = np.unpackbits(raw, axis=1).reshape(high, -1, depth)
        raw = (spread * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :wide]
    pixels = raw.reshape(high, wide, -1)
    alpha = np.full((high, wide), 255, np.uint8)
    if colour == 3:
        shown = np.full(len(palette), 255, np.uint8)
        shown[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        alpha, pixels = shown[pixels[..., 0]], palette[pixels[..., 0]]
    elif colour in (4, 6):
        alpha, pixels = pixels[..., -1], pixels[..., :-1]
    elif clear:
        alpha[(pixels == np.frombuffer(clear, ">u2")).all(axis=2)] = 0
    if colour == 0 and depth < 8:
        pixels = pixels * (255 // ((1 << depth) - 1))
    return np.dstack([np.broadcast_to(pixels, (high, wide, 3)), alpha]).astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """Luminance of each pixel; alpha is ignored."""
    return ((read_rgba(data)[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def write_rgba(pixels: np.ndarray) -> bytes:
    """An 8-bit image with alpha, losslessly."""
    high, wide, _ = pixels.shape
    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def _weights(given: int, wanted: int) -> np.ndarray:
    """Fixed-point Lanczos-3 weights, a row for each output sample."""
    ratio = given / wanted
    wide = max(ratio, 1.0)
    centre = (np.arange(wanted)[:, None] + 0.5) * ratio
    at = np.arange(given)[None, :]
    inside = (at >= np.floor(centre - 3 * wide + 0.5)) & (at < np.floor(centre + 3 * wide + 0.5))
    x = (at + 0.5 - centre) / wide
    w = np.where(inside & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << FIXED_BITS)
    return np.trunc(w + np.copysign(0.5, w)).astype(np.int64)


def resized(gray: np.ndarray, wide: int, high: int) -> np.ndarray:
    """Lanczos-3 in two passes, each rounded to 8 bits; a pass that keeps the size is skipped."""
    fixed = lambda v: np.clip((v + (1 << (FIXED_BITS - 1))) >> FIXED_BITS, 0, 255)
    out = gray.astype(np.int64)
    if out.shape[1] != wide:
        out = fixed(out @ _weights(out.shape[1], wide).T)
    if out.shape[0] != high:
        out = fixed(_weights(out.shape[0], high) @ out)
    return out


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def features(gray: np.ndarray) -> tuple[str, str, str, str, int, int]:
    """Average, difference and cosine hash (64 bits, hex), 16 luminance shares of 10,000, width, height."""
    small, slope, square = resized(gray, 8, 8), resized(gray, 9, 8), resized(gray, 32, 32).astype(float)
    c = _cosines(32)
    low = (c @ square @ c.T)[:8, :8].reshape(-1)
    waves = low >= np.median(low[1:])
    waves[0] = False
    counts = np.bincount(gray.reshape(-1) >> 4, minlength=16)
    shares = ",".join(str(round(int(n) / gray.size * 10000)) for n in counts)
    return _hex(64 * small >= small.sum()), _hex(slope[:, :-1] > slope[:, 1:]), _hex(waves), shares, gray.shape[1], gray.shape[0]


def _features(payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for data in payloads:
        try:
            rows.append(features(read_png(bytes(data))))
        except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
            rows.append((None,) * 6)
    return pd.DataFrame(rows, columns=["ahash", "dhash", "phash", "hist16", "width", "height"])


def image_features(payload: Column) -> Column:
    """Struct of all features; nulls where the payload cannot be read."""
    return F.pandas_udf(_features, "struct<ahash:string,dhash:string,phash:string,hist16:string,width:long,height:long>")(payload)


def _squares(levels: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else write_png(np.asarray(v).reshape(int(len(v) ** 0.5), -1)) for v in levels])


def gray_png(levels: Column) -> Column:
    """Square images of grey levels (an array a row), as PNG; null stays null."""
    return F.pandas_udf(_squares, "binary")(levels)


def _again(payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for data in payloads:
        try:
            pixels = read_rgba(bytes(data))
        except (ValueError, KeyError, TypeError, IndexError, struct.error, zlib.error):
            rows.append((None,) * 4)
            continue
        png = write_rgba(pixels)
        if not np.array_equal(read_rgba(png), pixels):
            raise ValueError("re-encoding changed pixels")
        rows.append((png, pixels.shape[1], pixels.shape[0], hashlib.sha256(pixels.tobytes()).hexdigest()))
    return pd.DataFrame(rows, columns=["png", "width", "height", "pixels_sha256"])


def reencoded(payload: Column) -> Column:
    """Struct of the image as plain RGBA PNG, its size and the sha256 of its pixels; the new bytes are read
    again and must give the same pixels.  Nulls where the payload cannot be read."""
    return F.pandas_udf(_again, "struct<png:binary,width:long,height:long,pixels_sha256:string>")(payload)
