"""GeoTIFF bytes to arrays and back: striped or tiled, plain or deflated, 8 and 16 bit and float samples.

Files are read by Spark's ``binaryFile`` source, so that any store that Spark can
read will do, and decoded in Arrow batches. A raster comes as blocks of rows; the
long form has a row for each pixel.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the TIFF field types, and the tags that are used.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113


@dataclass
class Raster:
    """``data``: height x width x bands. ``transform``: (a, b, c, d, e, f)."""

    data: np.ndarray
    transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    epsg: int = 0
    nodata: float | None = None


def _fields(raw: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", raw[4:8])[0]
    out: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        size = SIZES.get(kind, 1) * count
        start = at + 10 + 12 * k
        if size > 4:
            start = struct.unpack(order + "I", raw[start : start + 4])[0]
        part = raw[start : start + size]
        out[tag] = (part.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + CODES[kind] * count, part) if kind in CODES else (part,)
    return order, out


def decode(raw: bytes) -> Raster:
    order, tags = _fields(raw)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    height, width, bands = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
    kind = np.dtype({(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[one(FORMAT, 1), one(BITS, 8)]).newbyteorder(order)
    if one(PLANAR, 1) != 1 or one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError("planar or compressed in a way that is not read")
    tiled = TILE_OFFSETS in tags
    bh, bw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, height), height), width)
    offsets, counts = tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS]
    data = np.zeros((height, width, bands), kind.newbyteorder("="))
    across = -(-width // bw)
    for k, (start, size) in enumerate(zip(offsets, counts)):
        part = raw[start : start + size]
        if one(COMPRESSION, 1) != 1:
            part = zlib.decompress(part)
        r, c = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - r)
        block = np.frombuffer(part, kind, rows * bw * bands).reshape(rows, bw, bands)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        data[r : r + rows, c : c + bw] = block[: height - r, : width - c]
    transform = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    if SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIEPOINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = tags.get(KEYS, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072)), 0)
    nodata = one(NODATA)
    return Raster(data, transform, epsg, float(nodata) if nodata else None)


def encode(raster: Raster, tile: int = 256) -> bytes:
    """A deflated, tiled, little-endian file."""
    height, width, bands = raster.data.shape
    data = raster.data.astype(raster.data.dtype.newbyteorder("<"))
    blocks = []
    for r in range(0, height, tile):
        for c in range(0, width, tile):
            block = np.zeros((tile, tile, bands), data.dtype)
            part = data[r : r + tile, c : c + tile]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes()))
    kind = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    a, _, x, _, e, y = raster.transform
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (data.dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (2 if bands == 3 else 1,)),
        (SAMPLES, 3, (bands,)), (PLANAR, 3, (1,)), (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)), (TILE_OFFSETS, 4, (0,) * len(blocks)), (TILE_COUNTS, 4, tuple(map(len, blocks))),
        (FORMAT, 3, (kind,) * bands), (SCALE, 12, (a, -e, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, x, y, 0.0)),
    ]
    if raster.epsg:
        geographic = raster.epsg == 4326
        fields.append((KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, raster.epsg)))
    if raster.nodata is not None:
        fields.append((NODATA, 2, tuple(f"{raster.nodata:g}\0".encode())))
    fields.sort()

    def packed(kind: int, values: tuple) -> bytes:
        return bytes(values) if kind == 2 else struct.pack("<" + CODES[kind] * len(values), *values)

    extra_at = 8 + 2 + 12 * len(fields) + 4
    extra_size = sum(len(packed(k, v)) for _, k, v in fields if len(packed(k, v)) > 4)
    starts, at = [], extra_at + extra_size
    for block in blocks:
        starts.append(at)
        at += len(block)
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, kind, values in fields:
        part = packed(kind, tuple(starts) if tag == TILE_OFFSETS else values)
        head += struct.pack("<HHI", tag, kind, len(values))
        if len(part) <= 4:
            head += part.ljust(4, b"\0")
        else:
            head += struct.pack("<I", extra_at + len(extra))
            extra += part
    return head + struct.pack("<I", 0) + extra + b"".join(blocks)


def first_three(data: np.ndarray) -> np.ndarray:
    """Three bands: the first three, the last repeated where there are fewer."""
    return data[:, :, [min(k, data.shape[2] - 1) for k in range(3)]]


def read_blocks(spark: SparkSession, path: str, rows: int = 256) -> DataFrame:
    """(path, r0, height, width, bands, epsg, transform, values): blocks of rows of every file under a path, values in reading order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raster = decode(content.as_py())
                height, width, bands = raster.data.shape
                for r in range(0, height, rows):
                    part = raster.data[r : r + rows].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([path_]), pa.array([r]), pa.array([len(part)]), pa.array([width]), pa.array([bands]), pa.array([raster.epsg]), pa.array([list(raster.transform)]), pa.array([part.ravel()])], ["path", "r0", "height", "width", "bands", "epsg", "transform", "values"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(blocks, "path string, r0 long, height long, width long, bands long, epsg long, transform array<double>, values array<double>")


def to_pixels(blocks: DataFrame) -> DataFrame:
    """(path, r, c, band, v): a row for each sample."""
    each = blocks.select("path", "r0", "width", "bands", F.posexplode("values").alias("k", "v"))
    return each.select("path", (F.col("r0") + F.floor(F.col("k") / (F.col("width") * F.col("bands")))).alias("r"), (F.floor(F.col("k") / F.col("bands")) % F.col("width")).alias("c"), (F.col("k") % F.col("bands")).alias("band"), "v")


def encoded(pixels: DataFrame, key: str, value: str, dtype: str = "uint8", **georef) -> DataFrame:
    """(key, content): a file of one band for each key of (key, r, c, value); places without a row are 0."""

    def make(pdf):
        import pandas as pd

        r, c = (pdf["r"] - pdf["r"].min()).to_numpy(), (pdf["c"] - pdf["c"].min()).to_numpy()
        data = np.zeros((r.max() + 1, c.max() + 1, 1), dtype)
        data[r, c, 0] = pdf[value].to_numpy()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(Raster(data, **georef))]})

    return pixels.groupBy(key).applyInPandas(make, f"{key} {dict(pixels.dtypes)[key]}, content binary")
