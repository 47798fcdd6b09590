"""Operator 8: Netpbm and BMP columns as numpy arrays, NPY tiles and difference hashes.

``decode`` reads PBM, PGM and PPM (plain and raw, 8 and 16 bits) and uncompressed BMP
(1, 4, 8, 24 and 32 bits). ``area_resize`` averages over exact pixel areas with an
integral image, which costs the same at every scale. ``npy`` and ``difference_hash``
make a tile's NPY file and the 64-bit hash of its rows' brightness steps.

The query stores each text as samples of a raw PGM image, 24 a row, in a written
media table, reads the stored bytes back and computes its columns from these.

Defined results: null texts count as empty; an empty payload is one block of padding;
media bytes that are null, empty or not an image decode to nothing (null columns);
equal bytes give equal results; an empty table gives no rows; further columns are
ignored, whatever their names.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .words import flat

PAD, BLOCK, WIDTH, TILE = 255, 576, 24, 16


def decode(media: bytes | None) -> np.ndarray | None:
    """Pixels as (height, width) or (height, width, 3); None if these bytes aren't an image known here."""
    if not media or len(media) < 3:
        return None
    try:
        return _bmp(media) if media[:2] == b"BM" else _netpbm(media) if media[:1] == b"P" else None
    except (ValueError, struct.error, IndexError, TypeError):
        return None


def _netpbm(media: bytes) -> np.ndarray | None:
    kind = media[1:2]
    if kind not in b"123456":
        return None
    bitmap, plain = kind in b"14", kind in b"123"
    at, fields = 2, []
    for _ in range(2 if bitmap else 3):
        found = re.compile(rb"(?:[ \t\r\n\v\f]|#[^\r\n]*[\r\n])*(\d+)").match(media, at)
        fields.append(int(found[1]))
        at = found.end()
    width, height = fields[:2]
    top = 1 if bitmap else fields[2]
    if not 0 < top < 65536:
        return None
    depth = 3 if kind in b"36" else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    n = width * height * depth
    if plain:
        body = re.sub(rb"#[^\r\n]*", b"", media[at:])
        values = np.array(re.findall(rb"[01]", body) if bitmap else body.split(), dtype=np.int64)[:n]
    elif bitmap:
        row = (width + 7) // 8
        values = np.unpackbits(np.frombuffer(media, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(media, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(values) != n or (n and values.max() > top):
        return None
    if bitmap:
        values = 1 - values
    return values.astype(np.uint8 if top < 256 else np.uint16).reshape(shape)


def _bmp(media: bytes) -> np.ndarray | None:
    start, head = struct.unpack_from("<I", media, 10)[0], struct.unpack_from("<I", media, 14)[0]
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", media, 18)
        packed, used, entry = 0, 0, 3
    else:
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", media, 18)
        used, entry = struct.unpack_from("<I", media, 46)[0], 4
    if packed or bits not in (1, 4, 8, 24, 32) or width < 0:
        return None
    down, height = height < 0, abs(height)
    row = (width * bits + 31) // 32 * 4
    data = np.frombuffer(media, np.uint8, row * height, start).reshape(height, row)
    if bits <= 8:
        n = used or 1 << bits
        colours = np.frombuffer(media, np.uint8, n * entry, 14 + head).reshape(n, entry)[:, 2::-1]
        index = np.unpackbits(data, axis=1).reshape(height, -1, bits).dot(1 << np.arange(bits)[::-1])[:, :width] if bits < 8 else data[:, :width]
        grey = (colours == colours[:, :1]).all()
        pixels = colours[index][..., 0] if grey else colours[index]
    else:
        pixels = data[:, : width * bits // 8].reshape(height, width, bits // 8)[..., 2::-1]
    return np.ascontiguousarray(pixels if down else pixels[::-1])


def pgm(samples: np.ndarray) -> bytes:
    """A raw PGM of 8-bit samples (height, width)."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness of colours, by the integer weights of ITU-R BT.601 in thousandths."""
    return (pixels.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000 if pixels.ndim == 3 else pixels


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean brightness over each target pixel's exact area, as doubles; any scale, up or down."""
    h, w = pixels.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(pixels, axis=0, dtype=np.float64, out=integral[1:, 1:])
    np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])

    def cut(table: np.ndarray, n: int, to: int) -> np.ndarray:
        at = np.arange(to + 1) * n / to
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    sums = cut(cut(integral, h, height).T, w, width).T
    return np.diff(np.diff(sums, axis=0), axis=1) * (height * width / (h * w))


def npy(pixels: np.ndarray) -> bytes:
    """The NPY file of an array."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(pixels), version=(1, 0))
    return out.getvalue()


def difference_hash(brightness: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 8 places is brighter than the next to the right."""
    small = np.round(area_resize(brightness, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def tile_of(pixels: np.ndarray) -> bytes:
    return npy(np.clip(np.floor(area_resize(grey(pixels), TILE, TILE) + 0.5), 0, 255).astype(np.uint8))


def described(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds height, width, tile (NPY bytes) and dhash of a column of media bytes to its rows' ``id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, value in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                pixels = decode(value)
                rows.append((own, None, None, None, None) if pixels is None or not pixels.size else (own, *pixels.shape[:2], tile_of(pixels), difference_hash(grey(pixels))))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "height", "width", "tile", "dhash"])

    return media.select(F.col("id").cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, "id long, height int, width int, tile binary, dhash string")


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, n_bytes, media)."""
    for batch in batches:
        data, offsets = flat(batch.column(1))
        ids, sizes, media, kept = [], [], [], 0
        for own, low, high in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n = high - low
            padded = max(BLOCK, -(-n // BLOCK) * BLOCK)
            samples = np.full(padded, PAD, np.uint8)
            samples[:n] = data[low:high]
            ids.append(own)
            sizes.append(n)
            media.append(pgm(samples.reshape(-1, WIDTH)))
            kept += padded
            if kept > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                ids, sizes, media, kept = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, tile binary"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        for own, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = value.as_buffer()
            pixels = decode(media.to_pybytes())
            payload = pixels.tobytes()
            rows.append((own, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(pixels), *pixels.shape, tile_of(pixels)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def text_media(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes each text's samples as a PGM in a media table, reads it back and describes the images."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch.path("media")
    made = rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")
    made.write.option("compression", "zstd").parquet(path)
    return scratch.spark.read.schema(made.schema).parquet(path).mapInArrow(digest, DIGEST)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "tile")
    return text_media(read(spark, sf_dir, "documents"), Scratch(spark, "media")).select(*columns)
