"""Images as tables: folders, numbered files, PNG and PGM decoding in Arrow batches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import numbered_files


def missing_folders(spark: SparkSession, *folders: str) -> list[str]:
    """Those of the folders that don't exist, all of them named."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in folders:
        p = jvm.org.apache.hadoop.fs.Path(f)
        fs = p.getFileSystem(conf)
        if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
            out.append(f)
    return out


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, name, length`` of the files of a folder, contents not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")


def decode_pgm(raw: bytes) -> np.ndarray:
    """Binary PGM or PPM of 8 or 16 bits."""
    head, at = [], 2
    while len(head) < 3:
        while raw[at : at + 1].isspace():
            at += 1
        if raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1
            continue
        end = at
        while not raw[end : end + 1].isspace():
            end += 1
        head.append(int(raw[at:end]))
        at = end
    width, height, top = head
    channels = 3 if raw[:2] == b"P6" else 1
    kind = ">u2" if top > 255 else "u1"
    out = np.frombuffer(raw, kind, width * height * channels, at + 1).astype(np.int64)
    return out.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_png(raw: bytes) -> np.ndarray:
    """PNG of gray, RGB or RGBA pixels (8 or 16 bits, not interlaced)."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlaced:
        raise ValueError("unsupported kind of PNG")
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int64)
    for y in range(height):
        how, line = int(lines[y, 0]), lines[y, 1:].astype(np.int64)
        if how == 2:
            line = line + above & 255
        elif how == 1:
            line = (line.reshape(width, step).cumsum(0) & 255).ravel()
        elif how:
            for x in range(len(line)):
                a = line[x - step] if x >= step else 0
                b, c = above[x], above[x - step] if x >= step else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = line[x] + guess & 255
        out[y], above = line, line
    if depth == 16:
        out = out.reshape(height, -1, 2).astype(np.int64)
        out = out[:, :, 0] * 256 + out[:, :, 1]
    return out.astype(np.int64).reshape((height, width) if channels == 1 else (height, width, channels))


def encode_png(image: np.ndarray, depth: int = 16) -> bytes:
    """A gray (h x w) or RGB (h x w x 3) image as PNG."""
    kind = ">u2" if depth == 16 else "u1"
    lines = b"".join(b"\0" + row.astype(kind).tobytes() for row in image)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode(raw: bytes) -> np.ndarray:
    return decode_png(raw) if raw[:1] == b"\x89" else decode_pgm(raw)


def read_images(spark: SparkSession, folder: str, colour: bool = False, pattern: str = "*") -> DataFrame:
    """``image, row, col, depth`` (or ``r, g, b``) of the numbered files of a folder; one decoded image at a time is held."""
    files = numbered_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)).select("image", "content")

    def run(frames):
        for pdf in frames:
            for number, raw in zip(pdf["image"], pdf["content"], strict=True):
                x = decode(bytes(raw))
                r, c = np.indices(x.shape[:2]).reshape(2, -1)
                values = {k: x[:, :, i].ravel() for i, k in enumerate("rgb")} if colour else {"depth": x.ravel() if x.ndim == 2 else x[:, :, 0].ravel()}
                yield pd.DataFrame({"image": number, "row": r, "col": c, **values})

    return files.mapInPandas(run, "image int, row int, col int, " + ("r int, g int, b int" if colour else "depth int"))
