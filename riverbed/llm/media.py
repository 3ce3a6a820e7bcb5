"""Images in binary columns: Netpbm and BMP read to numpy arrays, resized by area, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import io
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

#: Side of a tile in samples; one tile holds TILE * TILE of them.
TILE = 24
PAD = 255
_HEADER = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", re.S)
#: Rows of an image that one step of a resize handles.
ROWS = 4096


def write_pgm(image: np.ndarray) -> bytes:
    """A grey (h, w) or colour (h, w, 3) array of 8-bit samples as binary Netpbm."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + image.tobytes()


def write_bmp(image: np.ndarray) -> bytes:
    """A grey (h, w) array as an 8-bit BMP with a grey palette, or (h, w, 3) as a 24-bit BMP; rows from the bottom."""
    h, w = image.shape[:2]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if image.ndim == 2 else b""
    samples = image.reshape(h, -1) if image.ndim == 2 else image[:, :, ::-1].reshape(h, -1)
    rows = np.zeros((h, -(-samples.shape[1] // 4) * 4), np.uint8)
    rows[:, : samples.shape[1]] = samples[::-1]
    at = 54 + len(palette)
    head = b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at)
    head += struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if image.ndim == 2 else 24, 0, rows.size, 2835, 2835, 256 if image.ndim == 2 else 0, 0)
    return head + palette + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The samples of a binary Netpbm (P5, P6) or an uncompressed BMP (8 or 24 bits), else ValueError."""
    if m := _HEADER.match(data):
        w, h, most = (int(x) for x in m.groups()[1:])
        shape = (h, w, 3) if m[1] == b"6" else (h, w)
        if most > 255 or len(data) - m.end() < int(np.prod(shape)):
            raise ValueError("Netpbm data are short, or not of 8 bits")
        return np.frombuffer(data, np.uint8, int(np.prod(shape)), m.end()).reshape(shape)
    if data[:2] == b"BM" and len(data) >= 54:
        at, size, w, h, _, bits, packing = struct.unpack_from("<I I i i H H I", data, 10)
        if packing or bits not in (8, 24) or w <= 0 or h == 0:
            raise ValueError("this kind of BMP isn't read")
        width, up = w * bits // 8, h > 0
        stride = -(-width // 4) * 4
        if len(data) < at + stride * abs(h):
            raise ValueError("BMP data are short")
        rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)[:, :width]
        rows = rows[::-1] if up else rows
        if bits == 24:
            return np.ascontiguousarray(rows.reshape(abs(h), w, 3)[:, :, ::-1])
        palette = np.frombuffer(data, np.uint8, 1024, 14 + size).reshape(256, 4)[:, :3]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][rows]
        return palette[:, ::-1][rows]
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output cell's area, from integral images of at most ROWS rows at a time; grey, as floats."""
    if image.ndim == 3:
        image = image.mean(axis=2)
    h, w = image.shape
    xs, ys = np.linspace(0, w, width + 1), np.linspace(0, h, height + 1)
    x0 = np.minimum(xs.astype(int), w - 1)
    total, out, at = np.zeros(width), np.zeros((height + 1, width)), 0
    for top in range(0, h, ROWS):
        part = image[top : top + ROWS]
        integral = np.zeros((len(part) + 1, w + 1))
        integral[1:, 1:] = part.cumsum(0, dtype=np.float64).cumsum(1)
        across = integral[:, x0] + (integral[:, x0 + 1] - integral[:, x0]) * (xs - x0)
        cells = np.diff(across, axis=1) + total  # sums of all rows above, by output column
        last = top + len(part)
        while at <= height and (ys[at] <= last or at == height and last == h):
            y = min(ys[at] - top, len(part))
            k = min(int(y), len(part) - 1)
            out[at] = cells[k] + (cells[k + 1] - cells[k]) * (y - k)
            at += 1
        total = cells[-1]
    return np.diff(out, axis=0) / ((w / width) * (h / height))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex digits: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def tiles(df: DataFrame, media: str = "media", side: int = TILE) -> DataFrame:
    """Decode a column of images; adds width, height, samples (the decoded bytes), tile (an NPY file of side x side
    8-bit samples, area-resized) and dhash. What isn't an image that decode() reads, null included, gets nulls.
    The columns of df stay, but those of these five names are replaced."""
    names = ["width", "height", "samples", "tile", "dhash"]
    df = df.drop(*names)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, width int, height int, samples binary, tile binary, dhash string"

    def one(data) -> tuple:
        try:
            image = decode(bytes(data) if data is not None else b"")
        except ValueError:
            return (None,) * 5
        small = np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)
        return image.shape[1], image.shape[0], image.tobytes(), to_npy(small), difference_hash(image)

    def run(batches):
        for b in batches:
            found = [one(x) for x in b[media]]
            for i, n in enumerate(names):
                b[n] = pd.Series([f[i] for f in found], index=b.index, dtype="Int32" if i < 2 else object)
            yield b

    return df.mapInPandas(run, schema)


def text_to_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes and media: the text's UTF-8 bytes (null: none), padded with PAD up to a positive multiple of a tile,
    as an image TILE samples wide: 8-bit BMP if the number of tiles is odd, else binary grey Netpbm."""
    df = df.drop("media", "n_bytes")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, n_bytes long, media binary"

    def one(value) -> tuple[int, bytes]:
        data = utf8(value)
        n = max(1, -(-len(data) // (TILE * TILE)))
        image = np.full(n * TILE * TILE, PAD, np.uint8)
        image[: len(data)] = np.frombuffer(data, np.uint8)
        image = image.reshape(-1, TILE)
        return len(data), write_bmp(image) if n % 2 else write_pgm(image)

    def run(batches):
        for b in batches:
            made = [one(x) for x in b[text]]
            yield b.assign(n_bytes=[m[0] for m in made], media=[m[1] for m in made])

    return df.mapInPandas(run, schema)


def op1_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an image, read back and reduced; one row a document. No shuffle: each row stands for itself."""
    stored = text_to_media(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    read = tiles(stored)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "dhash", F.lower(F.hex(F.crc32("tile")))).alias("feature"),
    )
