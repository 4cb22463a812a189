"""Masks as PNG files: read as tables of pixels, written one file's bytes a page.

One file is one row; a task decodes the files of its partition one by one, so it holds one picture.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Shares of red, green and blue in a grey value.
GREY = (0.299, 0.587, 0.114)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(raw: bytes, height: int, width: int, step: int) -> np.ndarray:
    """Rows of ``width`` bytes with the difference to neighbours undone; ``step`` bytes are a pixel."""
    rows = np.frombuffer(raw, np.uint8, height * (width + 1)).reshape(height, width + 1)
    out = np.zeros((height + 1, width + step), np.uint8)  # a row above and a pixel to the left of zeros
    for k in range(height):
        kind, line, above, here = rows[k, 0], rows[k, 1:], out[k, step:], out[k + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            pad = np.zeros(-len(line) % step, np.uint8)
            here[step:] = np.cumsum(np.concatenate([line, pad]).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
        elif kind == 2:
            here[step:] = line + above
        elif kind in (3, 4):
            left, up, corner = here, out[k], out[k]
            for x in range(width):
                a, b, c = int(left[x]), int(up[x + step]), int(corner[x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                here[x + step] = (int(line[x]) + guess) & 255
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:, step:]


def decoded(data: bytes) -> np.ndarray:
    """The grey values (0 to 255) of a PNG file that is not interlaced; alpha is left out."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    parts: dict[bytes, bytes] = {}
    for kind, body in _chunks(data):
        parts[kind] = parts.get(kind, b"") + body
    width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlaced:
        raise ValueError("interlaced PNG files are not read")
    n = CHANNELS[color]
    line = -(-width * n * depth // 8)
    rows = _unfiltered(zlib.decompress(parts[b"IDAT"]), height, line, max(1, n * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, :width]
        if color == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    pixels = rows[:, : width * n].reshape(height, width, n)
    if color == 3:
        pixels = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    if pixels.shape[2] >= 3:
        return np.rint(pixels[:, :, :3] @ np.array(GREY)).astype(np.uint8)
    return pixels[:, :, 0]


def encoded(values: np.ndarray) -> bytes:
    """Grey values as a PNG file, each row as its difference to the one above."""
    height, width = values.shape
    rows = np.concatenate([np.full((height, 1), 2, np.uint8), np.diff(values, axis=0, prepend=np.zeros((1, width), np.uint8))], axis=1)
    chunk = lambda kind, body: struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def mask_pixels(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, y, x, v): the pixels that are not black of files (key, content); an unreadable file is an error."""
    kind = dict(files.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, data in zip(part[key], part["content"]):
                try:
                    grey = decoded(bytes(data))
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    raise ValueError(f"Failed to read mask: {name}") from e
                y, x = np.nonzero(grey)
                yield pd.DataFrame({key: [name] * len(y), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": grey[y, x].astype(np.int32)})

    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, y int, x int, v int")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, v) of all PNG files below a path."""
    return mask_pixels(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path))


def mask_files(mask: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(page, content): each page's set pixels as a PNG file of the given size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros(size, np.uint8)
        grid[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = 255
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "content": [encoded(grid)]})

    return mask.select(F.col("page").cast("long").alias("page"), "y", "x").groupBy("page").applyInPandas(run, "page long, content binary")
