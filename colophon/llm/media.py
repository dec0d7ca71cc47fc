"""Media columns: Netpbm and BMP images decoded to numpy, resized by area, tiled and hashed.

A picture column is binary. ``decode`` reads Netpbm bitmaps, grey maps and pixel maps, plain and binary (P1 to P6), and
uncompressed BMP with a palette or of 24 or 32 bits; anything else is an error for that row, never for the
job. ``resize_area`` averages the exact (fractional) area below each target pixel, read off an
integral image, so its cost per target pixel doesn't depend on the scale. ``tiles`` writes a
picture as NPY files of bounded size; ``difference_hash`` compares neighbouring columns of a
9 x 8 reduction.

Texts become pictures by ``store``: payload bytes are the samples of an image 8 pixels wide,
kept as PPM or, for an even number of 192-byte blocks, as BMP. Cases: null and empty texts give
one block of spaces; texts of any length give a higher image; equal texts give equal rows;
repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colophon.llm.common import arrow_map

BLOCK, WIDTH, CHANNELS = 192, 8, 3
ROW = WIDTH * CHANNELS
BMP_HEADER = struct.Struct("<2sIHHI IiiHHIIiiII")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """P6 of a (height, width, 3) or P5 of a (height, width) array of uint8."""
    kind = b"P6" if pixels.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of a (height, width, 3) array of uint8."""
    height, width = pixels.shape[:2]
    pad = -width * 3 % 4
    rows = pixels[::-1, :, ::-1].reshape(height, width * 3)
    body = (np.pad(rows, ((0, 0), (0, pad))) if pad else np.ascontiguousarray(rows)).tobytes()
    return BMP_HEADER.pack(b"BM", BMP_HEADER.size + len(body), 0, 0, BMP_HEADER.size, 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def _netpbm_header(data: bytes, n: int) -> tuple[list[int], int]:
    """Width, height, largest sample (the first ``n`` of them) and where the samples begin; comments are skipped."""
    numbers: list[int] = []
    at = 2
    while len(numbers) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("damaged Netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def _bits(data: bytes, at: int, stride: int, height: int, width: int, depth: int) -> np.ndarray:
    """(height, width) values of ``depth`` bits, the first in the highest bits of its byte, in rows of ``stride`` bytes."""
    rows = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
    if depth == 8:
        return rows[:, :width]
    each = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
    return (each @ (1 << np.arange(depth)[::-1]).astype(np.uint8)).astype(np.uint8)[:, :width]


def _netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with samples of one or two bytes; samples are scaled to 255, and a set bit of a bitmap is black."""
    kind = data[1] - ord("0")
    bitmap, plain, channels = kind in (1, 4), kind < 4, 3 if kind in (3, 6) else 1
    numbers, at = _netpbm_header(data, 2 if bitmap else 3)
    width, height, top = (*numbers, 1) if bitmap else numbers
    if not 0 < top < 1 << 16:
        raise ValueError("the largest sample must be 1 to 65535")
    n = width * height * channels
    if plain:
        body = re.sub(rb"#[^\n]*", b" ", data[at - 1 :])
        found = re.findall(rb"[01]", body) if bitmap else body.split()
        samples = np.array(found[:n], np.int64)
    elif bitmap:
        stride = (width + 7) // 8
        samples = _bits(data, at, stride, height, width, 1).ravel() if len(data) - at >= stride * height else np.empty(0)
    else:
        size = 1 if top < 256 else 2
        samples = np.frombuffer(data, np.dtype(f">u{size}"), min(n, (len(data) - at) // size), at)
    if len(samples) < n:
        raise ValueError("the Netpbm image is cut short")
    samples = samples.reshape(height, width, channels)
    if bitmap:
        return ((1 - samples) * 255).astype(np.uint8)
    return np.asarray(samples, np.uint8) if top == 255 else (np.minimum(samples, top) * 255.0 / top + 0.5).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4 or 8 bits with a palette, or of 24 or 32 bits (the fourth byte is dropped)."""
    _, _, _, _, at, header, width, height, _, depth, packed, _, _, _, colours, _ = BMP_HEADER.unpack_from(data)
    if packed or depth not in (1, 4, 8, 24, 32) or header < 40:
        raise ValueError("only uncompressed BMP images of 1, 4, 8, 24 or 32 bits are read")
    stride, tall = (width * depth + 31) // 32 * 4, abs(height)
    if width <= 0 or len(data) - at < stride * tall:
        raise ValueError("the BMP image is cut short")
    if depth >= 24:
        wide = depth // 8
        pixels = np.frombuffer(data, np.uint8, stride * tall, at).reshape(tall, stride)[:, : width * wide].reshape(tall, width, wide)[:, :, 2::-1]
    else:
        size = colours or 1 << depth
        table = np.frombuffer(data, np.uint8, size * 4, 14 + header).reshape(size, 4)[:, 2::-1] if len(data) >= 14 + header + size * 4 else None
        places = _bits(data, at, stride, tall, width, depth)
        if table is None or places.size and places.max() >= size:
            raise ValueError("the BMP palette is cut short")
        pixels = table[places]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of uint8; ValueError for what isn't such an image."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _netpbm(data)
    if data[:2] == b"BM" and len(data) >= BMP_HEADER.size:
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area below each target pixel, as float64 of (height, width, channels)."""
    h, w, c = pixels.shape
    if not h or not w:
        return np.zeros((height, width, c))
    integral = np.zeros((h + 1, w + 1, c), np.int64)
    np.cumsum(pixels, axis=0, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(y.astype(np.int64), h - 1), np.minimum(x.astype(np.int64), w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    rows = integral[y0] * (1 - fy) + integral[y0 + 1] * fy
    sums = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    area = (h / height) * (w / width)
    return (sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]) / area


def grey(pixels: np.ndarray) -> np.ndarray:
    """(height, width, 1); the mean of the channels."""
    return pixels.mean(axis=2, keepdims=True)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as 16 hex digits: is each pixel of a 9 x 8 grey reduction darker than its right neighbour?"""
    small = np.round(grey(resize_area(pixels, 8, 9))[:, :, 0], 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tiles(pixels: np.ndarray, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of each tile of at most size x size pixels."""
    for y in range(0, pixels.shape[0], size):
        for x in range(0, pixels.shape[1], size):
            yield y // size, x // size, npy(pixels[y : y + size, x : x + size])


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8 and the bytes padded with spaces to whole blocks."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def store(data: bytes) -> bytes:
    """The payload as an image: BMP for an even number of blocks, else PPM."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, CHANNELS)
    return encode_netpbm(pixels) if len(data) // BLOCK % 2 else encode_bmp(pixels)


MEDIA_COLUMNS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary, media binary"


def text_media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text stored as an image, read back and described.

    ``tile`` is the NPY file of the 8 x 8 area reduction, ``media`` the stored image (null
    unless wanted), ``feature`` the difference hash and the tile's crc32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, data = payload(text)
                media = store(data)
                pixels = decode(media)
                back = pixels.tobytes()
                tile = npy(np.round(resize_area(pixels, 8, 8)).astype(np.uint8))
                feature = f"{difference_hash(pixels)}-{zlib.crc32(tile):08x}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, tile, media if keep_media else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True))], names=[x.split()[0] for x in MEDIA_COLUMNS.split(", ")])

    return arrow_map(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, MEDIA_COLUMNS)


def image_tiles(images: DataFrame, size: int = 256) -> DataFrame:
    """(id, row, column, tile, dhash, error) of a frame with ``id`` and ``media``.

    An undecodable image gives one row with its error; a null image is such a row too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pixels = decode(media or b"")
                    rows = [(y, x, t, difference_hash(pixels), None) for y, x, t in tiles(pixels, size)]
                except (ValueError, struct.error) as e:
                    rows = [(None, None, None, None, str(e))]
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True))], names=["id", "row", "column", "tile", "dhash", "error"])

    return images.selectExpr("cast(id as bigint) id", "media").mapInArrow(run, "id bigint, row int, column int, tile binary, dhash string, error string")
