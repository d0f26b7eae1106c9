"""Rasters in files: GeoTIFF (uncompressed or LZW strips and tiles, one band) and Parquet.

A TIFF is decoded where it lies, by a task per file, into rows; rasters of any size are better
kept as Parquet tables of cells, sorted by tile, which prune.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.operators.grid import Shape

#: TIFF tags in use.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS_PER_STRIP, COUNTS, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, NODATA = 33550, 33922, 42113
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "Q", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


@dataclass(frozen=True)
class Meta:
    """Affine map, nodata and size of a raster."""

    a: float = 1.0
    c: float = 0.0
    e: float = -1.0
    f: float = 0.0
    nodata: float | None = None
    rows: int = 0
    cols: int = 0

    @property
    def cell(self) -> float:
        return (abs(self.a) + abs(self.e)) / 2

    def shape(self) -> Shape:
        return Shape(self.rows, self.cols, self.cell)


def lzw_decode(raw: bytes) -> bytes:
    table: list[bytes] = []
    out, bits, at, width, last = bytearray(), 0, 0, 9, b""
    held = 0
    while True:
        while held < width:
            if at >= len(raw):
                return bytes(out)
            bits = (bits << 8) | raw[at]
            held += 8
            at += 1
        code = (bits >> (held - width)) & ((1 << width) - 1)
        held -= width
        bits &= (1 << held) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9


def lzw_encode(raw: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    size, width = 258, 9

    def put(code: int) -> None:
        nonlocal bits, held
        bits = (bits << width) | code
        held += width
        while held >= 8:
            out.append((bits >> (held - 8)) & 255)
            held -= 8
        bits &= (1 << held) - 1

    put(256)
    word = b""
    for k in range(len(raw)):
        more = word + raw[k : k + 1]
        if len(more) == 1 or more in table:
            word = more
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[more] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256)
            table, size, width = {}, 258, 9
        word = raw[k : k + 1]
    if word:
        put(table[word] if len(word) > 1 else word[0])
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of a classic TIFF."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in _KINDS:
            continue
        size = struct.calcsize(_KINDS[kind]) * n
        place = at + 10 + 12 * k
        if size > 4:
            place = struct.unpack(order + "I", raw[place : place + 4])[0]
        tags[tag] = struct.unpack(f"{order}{n}{_KINDS[kind]}", raw[place : place + size])
    return order, tags


def _meta(tags: dict[int, tuple]) -> Meta:
    meta = Meta(rows=tags[HEIGHT][0], cols=tags[WIDTH][0])
    if PIXEL_SCALE in tags and TIEPOINT in tags:
        sx, sy = tags[PIXEL_SCALE][:2]
        i, j, _, x, y, _ = tags[TIEPOINT][:6]
        meta = replace(meta, a=sx, e=-sy, c=x - i * sx, f=y + j * sy)
    if NODATA in tags:
        text = b"".join(tags[NODATA]).split(b"\0")[0].strip()
        meta = replace(meta, nodata=float(text) if text else None)
    return meta


def decode_tiff(raw: bytes) -> tuple[np.ndarray, Meta]:
    """Band 1 and the map of a classic TIFF."""
    order, tags = _tags(raw)
    rows, cols = tags[HEIGHT][0], tags[WIDTH][0]
    bits, form, compression = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0], tags.get(COMPRESSION, (1,))[0]
    if compression not in (1, 5):
        raise ValueError(f"compression {compression}")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    h, w = (tags[TILE_H][0], tags[TILE_W][0]) if tiled else (min(rows, tags.get(ROWS_PER_STRIP, (rows,))[0]), cols)
    out = np.zeros((rows, cols), dtype.newbyteorder("="))
    across = -(-cols // w)
    for k, (o, n) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS])):
        data = lzw_decode(raw[o : o + n]) if compression == 5 else raw[o : o + n]
        r, c = k // across * h, k % across * w
        high = h if tiled else min(h, rows - r)
        part = np.frombuffer(data, dtype, high * w).reshape(high, w)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[r : r + high, c : c + w] = part[: rows - r, : cols - c]
    return out, _meta(tags)


def encode_tiff(a: np.ndarray, meta: Meta, compress: bool = True) -> bytes:
    """A little-endian TIFF of one band in strips of about 8 KB."""
    a = np.ascontiguousarray(a, a.dtype.newbyteorder("<"))
    step = max(1, 8192 // max(1, a.strides[0]))
    strips = [lzw_encode(s) if compress else s for s in (a[k : k + step].tobytes() for k in range(0, a.shape[0], step))]
    nodata = b"" if meta.nodata is None else f"{meta.nodata:g}".encode() + b"\0"
    items: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (a.shape[1],)), (HEIGHT, "I", (a.shape[0],)), (BITS, "H", (a.itemsize * 8,)), (COMPRESSION, "H", (5 if compress else 1,)), (262, "H", (1,)),
        (OFFSETS, "I", tuple([0] * len(strips))), (277, "H", (1,)), (ROWS_PER_STRIP, "I", (step,)), (COUNTS, "I", tuple(map(len, strips))),
        (FORMAT, "H", ({"u": 1, "i": 2, "f": 3}[a.dtype.kind],)), (PIXEL_SCALE, "d", (abs(meta.a), abs(meta.e), 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, meta.c, meta.f, 0.0)),
        *([(NODATA, "s", (nodata,))] if nodata else []),
    ]
    codes = {v: k for k, v in _KINDS.items()}
    start = 8 + 2 + 12 * len(items) + 4
    size = lambda kind, v: len(v[0]) if kind == "s" else struct.calcsize(kind) * len(v)
    data = start + sum(size(k, v) + size(k, v) % 2 for _, k, v in items if size(k, v) > 4)
    offsets = tuple(data + sum(map(len, strips[:k])) for k in range(len(strips)))
    head, extra = b"II*\0" + struct.pack("<IH", 8, len(items)), b""
    for tag, kind, v in items:
        v = offsets if tag == OFFSETS else v
        body = v[0] if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        n = len(v[0]) if kind == "s" else len(v)
        head += struct.pack("<HHI", tag, codes[kind], n)
        if len(body) > 4:
            head += struct.pack("<I", start + len(extra))
            extra += body + b"\0" * (len(body) % 2)
        else:
            head += body.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + extra + b"".join(strips)


def read_meta(spark: SparkSession, path: str) -> Meta:
    """Map, nodata and size of the first file under ``path``; its tags are read by a task, and no pixel is decoded."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"meta": [json.dumps(asdict(_meta(_tags(bytes(raw))[1]))) for raw in pdf["content"]]})

    rows = spark.read.format("binaryFile").load(path).limit(1).select("content").mapInPandas(run, "meta string").collect()
    if not rows:
        raise FileNotFoundError(path)
    return Meta(**json.loads(rows[0]["meta"]))


def read_tiff(spark: SparkSession, path: str, value: str = "z") -> DataFrame:
    """``(file, r, c, value)`` of every TIFF under ``path``; nodata and NaN are NULL. A task decodes one file."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, raw in zip(pdf["path"], pdf["content"]):
                a, meta = decode_tiff(bytes(raw))
                step = max(1, 1_000_000 // max(1, a.shape[1]))
                for k in range(0, a.shape[0], step):
                    part = a[k : k + step].astype(float)
                    part = part if meta.nodata is None else np.where(part == meta.nodata, np.nan, part)
                    y, x = np.mgrid[k : k + part.shape[0], 0 : part.shape[1]]
                    yield pd.DataFrame({"file": name, "r": y.ravel().astype("int32"), "c": x.ravel().astype("int32"), value: part.ravel()})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, r int, c int, `{value}` double")
    return rows.withColumn(value, F.nanvl(value, F.lit(None)))


def to_tiff(cells: DataFrame, value: str, meta: Meta, dtype: str = "float32", compress: bool = True, most_cells: int = 50_000_000) -> bytes:
    """One file's bytes, put together on the driver: for rasters of up to ``most_cells``; larger ones are kept as Parquet."""
    if meta.rows * meta.cols > most_cells:
        raise ValueError("too large for one file; write the cells as Parquet")
    fill = meta.nodata if meta.nodata is not None else math.nan
    a = np.full((meta.rows, meta.cols), fill)
    for r in cells.select("r", "c", value).where(F.col(value).isNotNull()).toLocalIterator():
        a[r[0], r[1]] = r[2]
    return encode_tiff(a.astype(dtype), meta, compress)


def write_cells(cells: DataFrame, path: str, block: int = 1024) -> None:
    """Cells as Parquet, each file a stretch of tile rows, so that reads of a region touch few of them."""
    cells.withColumn("tile_r", F.floor(F.col("r") / block).cast("int")).repartitionByRange("tile_r", "c").sortWithinPartitions("r", "c").write.mode("overwrite").parquet(path)
