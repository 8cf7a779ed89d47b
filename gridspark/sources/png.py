"""PNG files to pixels and back: a scan of binary files whose decoding runs in the tasks, a row of pixels at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x89PNG\r\n\x1a\n"
# Fixed values of the format: samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """height x width x 4 straight samples and their depth (8 or 16); non-interlaced files of 8 or 16 bits."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, parts, palette, alpha = 8, [], None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if interlaced or depth not in (8, 16):
        raise ValueError("interlaced files and depths under 8 are not read")
    n = SAMPLES[colour]
    step, line = n * depth // 8, width * n * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, line + 1)
    out, up = np.empty((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        up = out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], up, step)
    pixels = out.view(">u2").astype(np.int64) if depth == 16 else out.astype(np.int64)
    pixels, top = pixels.reshape(height, width, n), (1 << depth) - 1
    if colour == 3:
        table = np.c_[palette, np.full(len(palette), 255)].astype(np.int64)
        table[: len(alpha), 3] = list(alpha)
        return table[pixels[..., 0]], 8
    rgba = np.full((height, width, 4), top, np.int64)
    rgba[..., :3] = pixels[..., : 3 if n > 2 else 1]
    if n in (2, 4):
        rgba[..., 3] = pixels[..., -1]
    return rgba, depth


def _unfilter(kind: int, row: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + up
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out, above = bytearray(row.tobytes()), up.tolist()
    for i in range(len(out)):
        left, top = (out[i - step] if i >= step else 0), above[i]
        if kind == 3:
            guess = (left + top) // 2
        else:
            corner = above[i - step] if i >= step else 0
            p = left + top - corner
            guess = min((abs(p - left), 0, left), (abs(p - top), 1, top), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode(rgba: np.ndarray, depth: int = 8) -> bytes:
    """An RGBA file with each row stored as differences to the one above."""
    rows = rgba.astype(">u2" if depth == 16 else np.uint8)
    flat = rows.reshape(len(rows), -1).view(np.uint8)
    delta = flat - np.r_[np.zeros((1, flat.shape[1]), np.uint8), flat[:-1]]
    body = zlib.compress(np.c_[np.full(len(flat), 2, np.uint8), delta].tobytes())

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", rgba.shape[1], rgba.shape[0], depth, 6, 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def sniff(content):
    """The kind of a file by its first bytes: png, jpeg, psd or null."""
    begins = lambda n, hexed: F.substring(content, 1, n) == F.unhex(F.lit(hexed))
    return F.when(begins(8, "89504E470D0A1A0A"), "png").when(begins(3, "FFD8FF"), "jpeg").when(begins(4, "38425053"), "psd")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """image, x, y, r, g, b, a (0..1, straight) of all PNG files below a path; others are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return decoded(files.where(sniff(F.col("content")) == "png"))


def decoded(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rgba, depth = decode(data)
                h, w, _ = rgba.shape
                lines = max(1, 65536 // w)
                for y in range(0, h, lines):
                    part = rgba[y : y + lines].reshape(-1, 4) / float((1 << depth) - 1)
                    ys, xs = np.divmod(np.arange(len(part)), w)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(xs), pa.array(ys + y), *(pa.array(part[:, k]) for k in range(4))], ["image", "x", "y", "r", "g", "b", "a"])

    return files.select("path", "content").mapInArrow(run, "image string, x bigint, y bigint, r double, g double, b double, a double")


def encoded(df: DataFrame, depth: int = 8) -> DataFrame:
    """image, content: one PNG file for each image of (image, x, y, r, g, b, a). An image is put together in one task, as its file is one object."""
    top = (1 << depth) - 1

    def run(key, table):
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.int64)
        for k, c in enumerate("rgba"):
            out[y, x, k] = np.floor(np.clip(table.column(c).to_numpy(), 0, 1) * top + 0.5)
        return pa.table({"image": [key[0].as_py()], "content": pa.array([encode(out, depth)], pa.binary())})

    return df.select("image", "x", "y", "r", "g", "b", "a").groupBy("image").applyInArrow(run, "image string, content binary")
