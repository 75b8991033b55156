"""Image functions: content and perceptual hashes, PNG decoding and the repair of premultiplied BGR PNGs.

Bytes are handled in Arrow batches; nothing but the Python standard library and numpy is needed.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by PNG colour type; other types are handled bytewise.
PIXEL = {6: 4, 2: 3}


def content_hash(content: Column) -> Column:
    """SHA-256 in lowercase hex."""
    return F.sha2(content, 256)


def hamming(a: Column, b: Column) -> Column:
    """Share of different bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def is_cgbi(content: Column) -> Column:
    """A PNG of at least 32 bytes whose header holds a CgBI chunk."""
    head = F.decode(F.substring(content, 9, 23), "ISO-8859-1")
    return F.coalesce((F.length(content) >= 32) & (F.hex(F.substring(content, 1, 8)) == SIGNATURE.hex().upper()) & head.contains("CgBI"), F.lit(False))


def broken_dialect(data: bytes) -> bool:
    """`is_cgbi` of bytes at hand."""
    return len(data) >= 32 and data.startswith(SIGNATURE) and b"CgBI" in data[8:31]


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(type, body) of a PNG's chunks up to IEND; checksums are not looked at."""
    at, out = len(SIGNATURE), []
    while len(data) - at >= 12:
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("a chunk runs over the end")
        out.append((kind, data[at + 8 : at + 8 + size]))
        at += 12 + size
        if kind == b"IEND":
            break
    return out


def png(parts: list[tuple[bytes, bytes]]) -> bytes:
    body = (struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)
    return SIGNATURE + b"".join(body)


def unfilter(raw: bytes, stride: int, height: int, bpp: int) -> np.ndarray:
    """Rows of bytes (height, stride) of filtered scan lines; bpp bytes lie between a byte and its left neighbour. Unknown filter types count as none."""
    lines = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line, row = lines[y, 0], lines[y, 1:], out[y]
        if kind == 1:  # running sums of each byte of a pixel
            for c in range(min(bpp, stride)):
                row[c::bpp] = np.cumsum(line[c::bpp], dtype=np.uint8)
        elif kind == 2:
            row[:] = line + above
        elif kind == 3:
            row[:] = np.frombuffer(_average(line.tobytes(), above.tobytes(), bpp), np.uint8)
        elif kind == 4:
            row[:] = np.frombuffer(_paeth(line.tobytes(), above.tobytes(), bpp), np.uint8)
        else:
            row[:] = line
        above = row
    return out


def _average(line: bytes, above: bytes, bpp: int) -> bytearray:
    """Each byte depends on the one before, so this is plain integers over bytes, the fastest that a sequential pass gets here."""
    out = bytearray(bpp) + line
    for i, (x, up) in enumerate(zip(line, above, strict=True)):
        out[i + bpp] = (x + ((out[i] + up) >> 1)) & 255
    return out[bpp:]


def _paeth(line: bytes, above: bytes, bpp: int) -> bytearray:
    out = bytearray(bpp) + line
    for i, (x, up, corner) in enumerate(zip(line, above, bytes(bpp) + above, strict=False)):
        left = out[i]
        da, db = up - corner, left - corner
        dc = abs(da + db)
        da, db = abs(da), abs(db)
        out[i + bpp] = (x + (left if da <= db and da <= dc else up if db <= dc else corner)) & 255
    return out[bpp:]


def repair_cgbi(data: bytes) -> bytes:
    """The standard PNG of a CgBI one: zlib data, RGB order and straight alpha. Raises ValueError on broken data."""
    parts, packed, head = [], b"", None
    for kind, body in chunks(data):
        if kind == b"CgBI":
            continue
        if kind == b"IHDR":
            head = struct.unpack(">IIBB", body[:10])
        if kind == b"IDAT":
            packed += body
            continue
        if kind == b"IEND" and packed:
            if head is None:
                raise ValueError("no header")
            parts.append((b"IDAT", _straight(packed, *head)))
        parts.append((kind, body))
    return png(parts)


def _straight(packed: bytes, width: int, height: int, _depth: int, colour: int) -> bytes:
    bpp = PIXEL.get(colour, 1)
    try:
        raw = zlib.decompressobj(-15).decompress(packed)
    except zlib.error as e:
        raise ValueError(f"broken image data: {e}") from e
    if len(raw) < height * (width * bpp + 1):
        raise ValueError("image data ends early")
    pixels = unfilter(raw, width * bpp, height, bpp).reshape(height, width, bpp).copy()
    if bpp >= 3:
        pixels[..., :3] = pixels[..., 2::-1]
    if bpp == 4:
        alpha = pixels[..., 3:].astype(np.int64)
        part = (alpha > 0) & (alpha < 255)
        whole = np.minimum(255, pixels[..., :3].astype(np.int64) * 255 // np.maximum(alpha, 1))
        pixels[..., :3] = np.where(part, whole, pixels[..., :3])
    lines = np.zeros((height, width * bpp + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    return zlib.compress(lines.tobytes())


def repaired_or_error(data: bytes) -> tuple[bytes | None, str | None]:
    """The repaired bytes, or the reason why there are none."""
    try:
        return repair_cgbi(data), None
    except (ValueError, struct.error) as e:
        return None, str(e)


@F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]))
def fixed_png(content: pd.Series) -> pd.DataFrame:
    """`repaired_or_error` of each content."""
    return pd.DataFrame([repaired_or_error(bytes(data)) for data in content], columns=["content", "error"])


#: Fixed values of the format: samples of a pixel by colour type; first column and row and their steps of the interlace passes.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _samples(raw: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) samples of one image of scan lines, and the bytes that it takes."""
    stride = (width * channels * depth + 7) // 8
    size = height * (stride + 1)
    if len(raw) < size:
        raise ValueError("image data ends early")
    rows = unfilter(raw[:size], stride, height, max(1, channels * depth // 8))
    if depth == 16:
        values = rows.reshape(height, -1, 2).view(">u2")[..., 0].astype(np.uint16)
    elif depth == 8:
        values = rows
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * channels * depth].reshape(height, -1, depth)
        values = bits @ (1 << np.arange(depth)[::-1])
    return values[:, : width * channels].reshape(height, width, channels).astype(np.uint16), size


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 4) RGBA of 8 bits of a PNG of any colour type, depth and interlace; a transparent colour or palette counts."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    parts = chunks(data)
    named = dict(parts)
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", named[b"IHDR"][:13])
    channels, raw = SAMPLES[colour], zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT"))
    if interlace:
        values = np.zeros((height, width, channels), np.uint16)
        for x, y, dx, dy in PASSES:
            w, h = len(range(x, width, dx)), len(range(y, height, dy))
            if w and h:
                values[y::dy, x::dx], used = _samples(raw, w, h, depth, channels)
                raw = raw[used:]
    else:
        values, _ = _samples(raw, width, height, depth, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    clear = named.get(b"tRNS", b"")
    if colour == 3:
        index = values[..., 0]
        out[..., :3] = np.frombuffer(named[b"PLTE"], np.uint8).reshape(-1, 3)[index]
        out[..., 3] = np.concatenate([np.frombuffer(clear, np.uint8), np.full(256, 255, np.uint8)])[index]
        return out
    if colour in (0, 2) and clear:
        hidden = np.frombuffer(clear[: 2 * channels], ">u2")
        out[..., 3] = np.where((values == hidden).all(axis=-1), 0, 255)
    narrow = (values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour in (0, 4):
        out[..., :3] = narrow[..., :1]
        if colour == 4:
            out[..., 3] = narrow[..., 1]
    else:
        out[..., :channels] = narrow
    return out


def _dct(n: int) -> np.ndarray:
    k, x = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)


_DCT = _dct(32)


def perceptual_hash(rgba: np.ndarray, opaque: int = 253) -> int:
    """64 bits: which of the 8 by 8 lowest frequencies of the 32 by 32 grey image lie above their median. Transparent is black."""
    grey = rgba[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    grey[rgba[..., 3] < opaque] = 0
    h, w = grey.shape
    # area means through an integral image, so that any size maps to 32 by 32 without holes
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)
    ys, xs = np.arange(32) * h // 32, np.arange(32) * w // 32
    ye, xe = np.maximum(ys + 1, (np.arange(32) + 1) * h // 32), np.maximum(xs + 1, (np.arange(32) + 1) * w // 32)
    small = (total[ye][:, xe] - total[ys][:, xe] - total[ye][:, xs] + total[ys][:, xs]) / ((ye - ys)[:, None] * (xe - xs)[None, :])
    low = (_DCT @ small @ _DCT.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def phash(content: pd.Series) -> pd.Series:
    """Perceptual hashes; null for images that can't be decoded."""

    def one(data):
        try:
            return perceptual_hash(decode_png(bytes(data)))
        except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError):
            return None

    return pd.Series([one(x) for x in content], dtype="Int64")
